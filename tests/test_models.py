"""Calls of text models."""

from pyspark.sql import functions as F

from codeloom.plans import models as M


def test_a_common_listing_is_not_written_into_each_prompt(spark, monkeypatch):
    monkeypatch.setattr(M, "PROMPT_CHARS", 5000)
    listing = "\n".join(f"{k} | C.m{k} | L1-L2" for k in range(1, 41))
    rows = spark.range(50).select("id", F.when(F.col("id") != 7, F.concat(F.lit("which "), "id")).alias("question"))

    def model(prompts):
        assert sum(map(len, prompts)) < 6000 and all(p.endswith(listing) for p in prompts)
        if any("which 3\n" in p for p in prompts):
            raise RuntimeError("down")
        return [f"{int(p.splitlines()[0].rsplit(' ', 1)[1]) + 1}, 99" for p in prompts]

    found = {r.id: list(r.picked or []) for r in M.picked_symbols(rows, model, listing).collect()}
    assert len(found) == 50 and found[7] == [] and found[3] == [] and found[20] == [21] and found[45] == []
    assert sum(map(bool, found.values())) > 25
