"""A section's answer is read once for all that its result says."""

from oracle import SF_DIR

from quire.plans.assembly import e20_assembled_results


def test_answers_are_read_once(spark):
    plan = e20_assembled_results(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 5  # documents (files and inventories) for sections and for results, answers once
