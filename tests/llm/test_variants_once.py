"""Fingerprint variants are dealt once, and links at distance 3 stay."""

from cohortlake.llm import simhash


def test_punctured_variants_are_shuffled_once(spark, monkeypatch):
    plans = {}

    def noted(df, label, own=simhash.staged):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return own(df, label)

    monkeypatch.setattr(simhash, "staged", noted)
    base = 0x0123456789ABCDEF
    far = base ^ (1 << 3 | 1 << 30 | 1 << 60)  # at distance 3, one bit in each block
    nodes = spark.createDataFrame([(base,), (far,), (far ^ (7 << 8),), (base ^ (15 << 40),)], "fp long")
    found = {r.fp: r.root for r in simhash.near_links(nodes).collect()}
    assert found[base] == found[far] == found[far ^ (7 << 8)] and found[base ^ (15 << 40)] == base ^ (15 << 40)
    exploded = [label for label, plan in plans.items() if label in ("simhash-doubtful", "simhash-members") and "Generate explode" in plan]
    assert exploded == ["simhash-members"]
