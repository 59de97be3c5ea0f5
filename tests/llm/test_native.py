"""Operators 1, 3 and 7 stay on DataFrame functions, jobs at build included."""

import pytest

from churnlake.llm import catalog, common, decontam, linededup, mixing


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_mix_sources", "op7_decontaminate"])
def test_no_python_in_any_plan(spark, name, monkeypatch):
    plans = []
    real = common.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    for module in (decontam, linededup, mixing):
        monkeypatch.setattr(module, "cut", cut)
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1
    for plan in plans:
        assert not any(marker in plan for marker in ("Python", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")), plan
