"""Domain rules with worked numbers: consensus, reliability, audits, planning, occurrences."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text
from sedimenta.operators import consensus, decisions, discovery, disclosure, estimators, occurrence, planning, taxonomy
from sedimenta.plans import rule_views, rules


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_reliability_of_the_worked_case(spark):
    got = {r.reviewer: r for r in estimators.reliability(rules.CONTROLS.df(spark), rules.OVERLAPS.df(spark)).collect()}
    able = got["able"]
    assert (able.control_accuracy, able.sensitivity, able.specificity, able.pairwise_agreement, able.adjudicated_accuracy) == (17 / 20, 0.9, 0.8, 0.8, 0.8)
    assert (able.estimate, able.weight, able.blockers) == (pytest.approx(0.8), pytest.approx(1.2), [])
    sd = math.sqrt(36 * 9 / (45 * 45 * 46))
    assert (able.low, able.high) == (pytest.approx(0.8 - estimators.Z95 * sd), pytest.approx(0.8 + estimators.Z95 * sd))
    new = got["new"]
    assert (new.estimate, new.weight, new.sensitivity) == (None, None, None) and len(new.blockers) == 5
    assert got["only_controls"].pairwise_agreement is None and got["only_controls"].alpha is None


def test_a_survey_audit(spark):
    rows = [("s1", 0.6, 0.1, i < 3) for i in range(4)] + [("s2", 0.4, 0.1, i < 1) for i in range(2)]
    h = estimators.hajek(spark.createDataFrame(rows, "stratum string, share double, p double, supported boolean")).first()
    assert (h.estimate, h.ess) == (pytest.approx(0.65), pytest.approx(1 / 0.17))


def test_consensus_statuses(spark):
    got = {(r.subject, r.layer): r for r in consensus.layers(rules.REVIEWS.df(spark), rules.ADJUDICATIONS.df(spark), rules.GATES.df(spark)).collect()}
    assert {s: got[s, "community"].overall for s, layer in got if layer == "community"} == {
        "agree": "complete_agreement", "split": "unresolved_disagreement", "ruled": "adjudicated", "misruled": "unresolved_disagreement", "unsure": "uncertain_only", "dark": "media_failure", "late": "deferred",
        "one": "pending", "doubt": "unresolved_disagreement", "against": "complete_agreement",
    }
    assert got["agree", "release"].outcome == "release_ready" and got["against", "release"].blockers == []
    assert got["agree", "qualified"].support_total == 2.5 and "adjudication:no_decisive_disagreement" in got["agree", "qualified"].blockers
    heavy = rules.REVIEWS.df(spark).withColumn("weight", F.lit(2.5))
    with pytest.raises(Exception, match="outside policy"):
        consensus.layers(heavy, rules.ADJUDICATIONS.df(spark), rules.GATES.df(spark)).collect()


def test_retry_delays(spark):
    # 2 * 2^attempt, times a jitter from 0.5 to 1, or Retry-After if that is longer
    r = lambda *a: tuple(one(spark, r=planning.retry(*map(F.lit, a))).r)
    status, reason, attempt, delay = r("consumed", 429, 0, "x", None)
    assert (status, reason, attempt) == ("scheduled", "retryable_http_status", 1) and delay in (1, 2)
    assert r("consumed", 503, 2, "x", 90)[3] == 90 and 4 <= r("consumed", 503, 2, "x", 1)[3] <= 8
    assert r("consumed", 503, 3, "x", 90)[0] == "exhausted" and r("uncertain", 503, 0, "x", None)[0] == "blocked_accounting_reconciliation"


def test_bands_and_spatial_states(spark):
    bands = {None: "undated_or_unparseable", 1599: "outside_declared_valid_year_range", 1899: "pre_1900_historical", 1900: "1900_1949_historical", 1950: "1950_1999", 2000: "2000_snapshot_year", 2025: "outside_declared_valid_year_range"}
    for year, band in bands.items():
        assert one(spark, b=text.temporal_band(F.lit(year).cast("int"), 2024)).b == band
    state = lambda *a: one(spark, s=decisions.spatial_eligibility(*[F.lit(x).cast("boolean") for x in a])).s
    assert state(True, True, None, False) == "excluded_spatial_validity_not_supplied" and state(True, True, False, False) == "excluded_spatially_suspect"
    assert state(True, True, True, True) == "eligible_generalised_coarse_only"


def test_occurrences_fail_closed(spark):
    raw = rules.BROKEN.df(spark)
    with pytest.raises(Exception, match="source row 1: no_record_id"):
        occurrence.normalise(raw.where("source_row_number = 1"), rules.CONCEPTS.df(spark), rules.RECEIPT, rules.LICENCES).collect()
    typed = occurrence.normalise(rules.RAW.df(spark), rules.CONCEPTS.df(spark), rules.RECEIPT, rules.LICENCES)
    assert dict(typed.dtypes) == {c: k.replace("long", "bigint") for c, k in occurrence.TYPED.items()} and len(typed.columns) == 45
    assert typed.select("occurrence_fingerprint").distinct().count() == typed.count() and occurrence.unsafe_rows(typed).count() == 0
    assert {tuple(r["columns"]) for r in occurrence.unsafe_rows(typed.withColumns({"event_year": F.lit("x"), "licence": F.lit(None).cast("string")})).collect()} == {("event_year", "licence")}
    with pytest.raises(Exception, match="contradicts"):
        occurrence.eligible(typed.withColumn("coordinates_publicly_generalised", F.lit(True))).collect()
    sample = {r.record_id: r.source_reference for r in occurrence.public_sample(typed, "https://x/").collect()}
    assert sample["r1"] == "https://x/r1"
    datasets = spark.createDataFrame([("d1", "blocked_pending_citation_rights_resolution"), ("d2", "clear")], "data_resource_uid string, rights_review_state string")
    assert [r.data_resource_uid for r in occurrence.blocked_datasets(datasets, datasets.where("data_resource_uid = 'd1'")).collect()] == ["d1"]
    with pytest.raises(Exception, match="no longer blocked"):
        occurrence.blocked_datasets(datasets, datasets).collect()


def test_numbers_as_json(spark):
    got = {r.id: r.json for r in rules.q_rule_numbers(spark, "").collect()}
    wanted = ["0", "0", "1", "-1.5", "0.1", "1e+21", "100000000000000000000", "123456789012345680000", "0.000001", "1e-7", "1.2345e-7", "4.5", "333333333.3333333", "5e-324", "1.7976931348623157e+308", "null"]
    assert [got[i] for i in sorted(got)] == [f'{{"id":{i},"note":"a\\"\\n€","x":{x}}}' for i, x in enumerate(wanted)]
    assert all(float(json.loads(got[i])["x"]) == x for i, x in rules.NUMBERS.rows if x is not None)


def test_names_and_ledgers_fail_closed(spark):
    with pytest.raises(Exception, match="invalid_assertion_id, invalid_name"):
        discovery.definitions(rule_views.WRONG.df(spark)).collect()
    twice = rule_views.NAMES.df(spark).withColumn("normalized", F.lit("aus")).withColumn("name", F.lit("Aus"))
    with pytest.raises(Exception, match="several taxa"):
        discovery.definitions(twice).collect()
    defined = discovery.definitions(rule_views.NAMES.df(spark))
    with pytest.raises(Exception, match="unknown definition"):
        discovery.requests(spark.createDataFrame([("a", "d", "f")], "association string, definition string, fingerprint string"), defined, {}).collect()
    with pytest.raises(Exception, match="repeated work"):
        discovery.resume_plan(rule_views.ITEMS.df(spark).union(rule_views.ITEMS.df(spark)), spark.createDataFrame([], "work string, output string")).collect()
    odd = [2.0**-44, 2e-3, 1e23, 9007199254740993.0, 1 / 3, 5e-323, 1e16]
    numbers = spark.createDataFrame([(x,) for x in odd], "x double").select(text.json_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in numbers] == ["5.684341886080802e-14", "0.002", "1e+23", "9007199254740992", "0.3333333333333333", "5e-323", "10000000000000000"]
    path = F.array(F.struct(F.lit("family").alias("rank"), F.lit("F").alias("name")), F.struct(F.lit("genus").alias("rank"), F.lit("G").alias("name")))
    r = one(spark, m=taxonomy.lineage_map(path, F.lit("species"), F.lit("S")), p=taxonomy.without_ranks(path, ("genus",)))
    assert r.m == {"family": "F", "genus": "G", "species": "S"} and [x.name for x in r.p] == ["F"]
    with pytest.raises(Exception, match="differ"):
        taxonomy.zip_responses(spark.createDataFrame([(1, ["a"], [])], "batch long, keys array<string>, responses array<string>")).collect()


def test_pages_need_every_item(spark):
    assert {r.page: r.admitted for r in disclosure.admitted_page(rule_views.PAGED.df(spark)).collect()} == {"g1": True, "g2": False, "g3": False}
