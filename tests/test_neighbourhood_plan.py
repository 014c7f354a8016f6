"""q_neighbourhood reads its loci from a written table."""

from peptide_context.jobs.queries import QUERIES


def test_loci_are_made_once(spark):
    plan = QUERIES["q_neighbourhood"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan  # before, each of three readings of the loci held plans over line items and orders
