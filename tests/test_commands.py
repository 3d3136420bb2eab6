"""The command compositions (validate, analyze, score, plan, simulate, action, outreach, schedule, track, metrics)."""

import datetime as dt

from pyspark.sql import functions as F

from receivables.plans import commands
from receivables.plans.catalog import AS_OF
from receivables.sources.fixtures import Fixtures

from conftest import SF_SMALL


def test_commands_run_on_fixtures(spark):
    fx = Fixtures.of(spark, SF_SMALL)
    c, i, p = fx.customers, fx.invoices, fx.payments
    v = {r.table: r.is_valid for r in commands.validate(c, i, p).collect()}
    assert set(v) == {"customers", "invoices", "payments"}
    rep = commands.analyze(i, p, AS_OF).first()
    assert rep.ar_summary.total_ar > 0 and len(rep.aging_summary) >= 1
    top = commands.score(c, i, p, AS_OF, top=20).collect()
    assert len(top) == 20 and top[0].risk_score >= top[-1].risk_score
    plan = commands.plan(c, i, p, fx.csv_actions, AS_OF, top=30).collect()
    assert len(plan) == 30 and all(r.recommended_action for r in plan)
    sim = commands.simulate(i, p, AS_OF, scenarios=20, days=30).first()
    assert sim.p10 <= sim.p50 <= sim.p90
    ids = i.where("status = 'open'").select("invoice_id").limit(3)
    acts = commands.action(spark.createDataFrame([], "action_id string, invoice_id string, action_type string, "
                                                     "action_date timestamp_ntz, notes string, outcome string"),
                           ids, "reminder1", dt.datetime(2001, 7, 1))
    assert acts.count() == 3
    msgs = commands.outreach_messages(c, i, p, AS_OF, "second_notice", top=5).collect()
    assert len(msgs) == 5 and all(m.email_subject.startswith("SECOND NOTICE") for m in msgs)
    sched, week = commands.schedule_command(c, i, p, AS_OF, max_attempts=3)
    assert sched.groupBy("invoice_id").count().agg(F.max("count")).first()[0] == 3
    assert week.where(F.col("scheduled_date") > F.lit(AS_OF + dt.timedelta(days=7))).count() == 0
    a, r, o = fx.audit_actions, fx.audit_responses, fx.audit_outcomes
    inv = a.select("invoice_id").first().invoice_id
    assert commands.track(a, r, o, invoice_id=inv).where(F.col("invoice_id") != inv).count() == 0
    sm, eff = commands.metrics_command(a, r, o)
    assert sm.first().total_actions == a.count() and eff.count() >= 1
