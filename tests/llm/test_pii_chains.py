"""Bootstrapped finds at the end of long chains."""

from loanloom.llm.pii import confident_instances


def test_chain_of_five_steps(spark):
    """Two patterns a step hold 40 seeds, the 12 instances of the step before and 12 new ones: sure only after that step."""
    edges = []
    for step in range(5):
        for side in "ab":
            members = [(f"seed{step}-{k}", True) for k in range(60 if step == 0 else 40)]
            members += [(f"u{at}-{k}", False) for at in (step, step + 1) if at > 0 for k in range(12)]
            edges += [(f"p{step}{side}", instance, known) for instance, known in members]
    edges += [("p5", f"u5-{k}", False) for k in range(2)] + [("p5", f"v{k}", False) for k in range(9)]
    got = confident_instances(spark.createDataFrame(edges, "pattern string, instance string, known boolean")).collect()
    assert sorted(r["instance"] for r in got) == sorted(f"u{step}-{k}" for step in range(1, 6) for k in range(12))
