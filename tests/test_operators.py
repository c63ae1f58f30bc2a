"""Golden cases of the triage operators, worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators import adjudicate, asof, classify, context, knowledge, memory, scoring, sessions
from alertloom.plans.triage import TriageConfig, split_fit

T0 = datetime(2024, 1, 1, 12)
ALERT = "alert_id string, ts timestamp, alert_source string, alert_semantics string, source_entity string, target_entity string, service string, attributes string"


def alert(ident, seconds=0, semantics="port scan", source="s", target="t", service="tcp/80", attributes="{}", detector="d"):
    return (ident, T0 + timedelta(seconds=seconds), detector, semantics, source, target, service, attributes)


def frame(spark, rows):
    return spark.createDataFrame(rows, ALERT)


def groups(objects):
    return sorted(sorted(r.member_ids) for r in objects.collect())


def aggregated(spark, rows, **options):
    return sessions.aggregate_sessions(frame(spark, rows), **options)


def test_session_gap_is_inclusive(spark):
    rows = [alert("a", 0), alert("b", 60), alert("c", 121)]
    assert groups(aggregated(spark, rows)) == [["a", "b"], ["c"]]


def test_session_cap_is_inclusive(spark):
    rows = [alert(f"{i:02}", 60 * i) for i in range(17)]
    found = groups(aggregated(spark, rows))
    assert found == [[f"{i:02}" for i in range(16)], ["16"]]


def test_single_alerts_stay_raw(spark):
    objects = aggregated(spark, [alert("a"), alert("b", semantics="calm")])
    assert [r.object_type for r in objects.collect()] == ["alert", "alert"]


def test_scan_targets_collapse_and_statistics(spark):
    rows = [alert("a", 0, target="t1", service="tcp/80"), alert("b", 30, target="t2", service="tcp/443")]
    r = aggregated(spark, rows).first()
    assert r.targets == ["t1", "t2"] and r.services == ["tcp"] and r.object_id.startswith("m1-scan-")
    s = r.statistics
    assert (s.member_count, s.duration_bucket, s.event_rate_bucket, s.destination_ports) == (2, "<1m", "1-10/min", ["80", "443"])
    assert (r.alert_source, r.alert_semantics) == ("d", "scan:service_scan")


def test_brute_force_keeps_targets_apart(spark):
    rows = [alert("a", 0, "login fail", target="t1"), alert("b", 5, "login fail", target="t2"), alert("c", 9, "login fail", target="t1")]
    assert groups(aggregated(spark, rows)) == [["a", "c"], ["b"]]


def test_fixed_window(spark):
    rows = [alert("a", 0, "x"), alert("b", 50, "x"), alert("c", 61, "x")]
    assert groups(sessions.aggregate_fixed_windows(frame(spark, rows))) == [["a", "b"], ["c"]]


@pytest.mark.parametrize("gap", [40, None])
def test_chained_starts_equal_the_sequential_fold(spark, gap, monkeypatch):
    rows = [alert(f"{i:03}", (i * i * 7) % 1900 // 3 + 200 * (i % 3 == 0) - 10**9 * (i % 2), source=None if i % 5 else "s") for i in range(200)]
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        t = (r[1] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        first, before = last.get(r[4], (None, None))
        if first is None or t - first > 90 * 10**6 or (gap is not None and t - before > gap * 10**6):
            first = t
        last[r[4]] = (first, t)
        want[r[0]] = first
    walked = []
    monkeypatch.setattr(sessions, "_chained_starts", lambda *a, f=sessions._chained_starts: walked.append(1) or f(*a))
    found = sessions.session_starts(frame(spark, rows), ["source_entity"], "ts", "alert_id", gap, 90, fold_times=3)
    assert {r.alert_id: r.session_start for r in found.collect()} == want and walked


def test_provenance_gathers_only_the_first_ids(spark):
    rows = frame(spark, [alert(f"{i:04}", -i) for i in range(3000)]).withColumn("template", F.lit("x"))
    found = knowledge.knowledge_documents(rows)
    r = found.first()
    assert (r.support, r.representative, r.provenance) == (3000, "2999", [f"{2999 - i:04}" for i in range(20)])
    assert "_k" in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_ids_end_the_job(spark):
    with pytest.raises(Exception, match="duplicate alert id"):
        aggregated(spark, [alert("a"), alert("a", 5)]).collect()


def test_tunnel_takes_short_continuations(spark):
    name = "12x3-.4-.data.evil.com"
    dns = lambda q: '{"payload_fields":{"dns":{"rrname":"%s"}},"protocol":"dns"}' % q
    rows = [
        alert("a", 0, "odd dns", service="dns/53", attributes=dns(name)),
        alert("b", 30, "odd dns", service="dns/53", attributes=dns("x.evil.com")),
        alert("c", 40, "odd dns", service="dns/53", attributes=dns("x.good.com")),
        alert("d", 95, "odd dns", service="dns/53", attributes=dns("y.evil.com")),
    ]
    assert groups(aggregated(spark, rows)) == [["a", "b"], ["c"], ["d"]]


def test_classification_order(spark):
    rows = [
        alert("1", semantics="scan", attributes='{"destination_port":"80"}'),
        alert("2", semantics="WPScan agent"),
        alert("3", semantics="dns sweep"),
        alert("4", semantics="sweep", service=None),
        alert("5", semantics="invalid handshake", service=None),
        alert("6", semantics="RDP brute force"),
        alert("7", semantics="DDoS by SYN"),
        alert("8", semantics="calm", attributes='{"payload_fields":{"raw_log_data":["1.2.3.4 - - \\"GET /x HTTP/1.1\\" 404 5"]}}'),
        alert("9", semantics="calm"),
    ]
    got = {r.alert_id: r.family for r in classify.behaviours(frame(spark, rows)).collect()}
    assert got == {
        "1": "service_scan", "2": "web_scan:wpscan", "3": "dns_scan", "4": "network_scan", "5": "protocol_scan",
        "6": "rdp_authentication", "7": "syn_flood", "8": "web_scan:enumeration", "9": None,
    }


def test_weak_evidence_joins_a_near_scan(spark):
    rows = [alert("s", 0, "nikto"), alert("w", 61, "common web attack", service="apache"), alert("v", 60, "Common web attack url", service="apache")]
    got = {r.alert_id: (r.family, r.signal) for r in classify.behaviours(frame(spark, rows)).collect()}
    assert got["w"] == (None, None) and got["v"] == ("web_scan:enumeration", "correlated_web_scan_session")


def test_rules_are_tried_once_for_all_readers(spark):
    """What reads behaviours reads tables: neither the rules nor the Python that finds names run again."""
    rows = [alert("s", 0, "nikto"), alert("w", 60, "common web attack url", service="apache"), alert("x", 5, "calm")]
    found = classify.behaviours(frame(spark, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "rlike" not in plan.lower() and found.count() == 3


def test_fields_are_found_however_their_keys_are_spelt(spark):
    texts = ['{"destination_port": "443"}', '{"destination_\\u0070ort": ["80", "x", "9"]}', '{"dport": ""}', '{"note": "dport"}', None, "{}", '{"note": "\\u0041"}', "no json dport"]
    rows = spark.createDataFrame([(i, t, "tcp/22") for i, t in enumerate(texts)], "i int, attributes string, service string")
    got = {r.i: r.p for r in rows.select("i", classify.destination_ports().alias("p")).collect()}
    assert got == {0: ["443"], 1: ["9", "80", "x"], **{i: ["22"] for i in range(2, 8)}}


def test_asof_tie_takes_the_earlier_seed(spark):
    rows = frame(spark, [alert("a", -10, "one"), alert("b", 10, "two"), alert("p", 0, "probe"), alert("q", 200, "probe")])
    probe = F.col("alert_semantics") == "probe"
    got = asof.nearest_seed(rows, ["source_entity"], "ts", "alert_id", "alert_semantics", ~probe, probe, 60)
    assert {r.alert_id: r._near for r in got.collect()} == {"a": None, "b": None, "p": "one", "q": None}


def raw(spark, rows):
    return sessions._raw_objects(frame(spark, rows))


def scored(spark, rows, **options):
    pattern = F.struct("alert_semantics")
    return scoring.score(raw(spark, rows).withColumn("pattern", pattern), **options)


def test_a_lone_alert_is_a_candidate(spark):
    r = scoring.ranked(scored(spark, [alert("a")])).first()
    assert (r.pattern_score, r.entity_score, r.relation_score, r.total, r.rank, r.forwarded) == (1.0, 1.0, 1.0, pytest.approx(1.0), 1, True)


def test_days_are_scored_apart_and_ties_ranked_by_id(spark):
    rows = [alert("b", 12 * 3600 - 1), alert("a", 12 * 3600), alert("c", 0, "other", None, None, None)]
    got = {r.object_id: r for r in scoring.ranked(scored(spark, rows)).collect()}
    assert got["a"].rank < got["b"].rank and got["c"].entity_frequency == 1.0
    assert got["a"].window_start == datetime(2024, 1, 2)


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        scored(spark, [alert("a")], weights=(0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        TriageConfig(hops=9)


def test_meta_patterns_and_tables(spark):
    objects = aggregated(spark, [alert("a", 0), alert("b", 5), alert("z", 9, "calm")])
    with_pattern = scoring.with_pattern(objects)
    tables = scoring.graph_tables(objects, frame(spark, [alert("a"), alert("b"), alert("z")]), scoring.score(with_pattern))
    assert tables["graph_member_edges"].count() == 3 and tables["graph_scores"].count() == 2
    assert tables["graph_original_alerts"].count() == 3 and tables["graph_entity_nodes"].count() == 2


def evidence(spark, rows, current, direction, **options):
    objects = raw(spark, rows)
    found = context.context(objects, objects.filter(F.col("object_id") == current), direction, **options).collect()
    return sorted((r.relevance_rank, r.cand_id, r.relationship, r.hop) for r in found)


def test_context_is_strict_in_time_and_bounded(spark):
    rows = [alert("x", 0), alert("same", 0), alert("old", -1801), alert("pair", -100), alert("tgt", -10, source="o"), alert("prev", -20, source="o", target="s")]
    assert evidence(spark, rows, "x", "backward") == [
        (1, "pair", "same_source_target_pair", 1), (2, "prev", "predecessor_to_source_progression", 1), (3, "tgt", "shared_target", 1),
    ]
    assert len(evidence(spark, rows, "x", "backward", most=2)) == 2


def test_forward_context_follows_targets_only(spark):
    rows = [alert("x", 0), alert("src", 5, target="other"), alert("go", 9, source="t", target="u")]
    assert evidence(spark, rows, "x", "forward") == [(1, "go", "target_to_source_progression", 1)]


def test_chains_stay_whole(spark):
    rows = [alert("x", 0), alert("h1", -10, source="a", target="t"), alert("h2", -20, source="a", target="b"), alert("h3", -30, source="c", target="b"), alert("n", -5, source="q", target="t")]
    got = evidence(spark, rows, "x", "backward", hops=3, most=3)
    assert [(c, h) for _, c, _, h in got] == [("n", 1), ("h1", 1), ("h2", 2)]


def test_prefix_tree_reaches_the_missing_layer(spark):
    paths = spark.createDataFrame([("a", "b", "c"), ("a", "b", "c"), ("a", "x", "c")], "l1 string, l2 string, l3 string")
    layers = ("l1", "l2", "l3")
    tree = memory.prefix_tree(paths, layers)
    assert tuple(memory.tree_summary(tree, 3).first()) == (6, 2, 3)
    probes = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "z"), (3, "q", "b", "c")], "id int, l1 string, l2 string, l3 string")
    got = {r.id: (r.matched_depth, r.missing_layer, r.terminal_support) for r in memory.match_tree(probes, tree, "id", layers).collect()}
    assert got == {1: (3, None, 2), 2: (2, "l3", 0), 3: (0, "l1", 0)}


def decisions(spark, learnt, tested, **options):
    prints = memory.learn(raw(spark, learnt))
    return {r.object_id: (r.decision, r.reason) for r in memory.decide(raw(spark, tested), prints, **options).collect()}


def test_memory_decides_exact_subnet_and_shape(spark):
    payload = lambda t: '{"payload_fields":{"m":"u=1 session=%s"}}' % t
    learnt = [
        alert("1", source="10.0.0.1", attributes=payload("11")), alert("2", source="10.0.0.2", attributes=payload("11")),
        alert("3", semantics="tok", attributes=payload("11")), alert("4", semantics="tok", attributes=payload("22")),
    ]
    tested = [
        alert("exact", source="10.0.0.1", attributes=payload("11")), alert("net", source="10.0.0.77", attributes=payload("11")),
        alert("far", source="10.0.1.1", attributes=payload("11")), alert("digits", semantics="tok", attributes=payload("33")),
        alert("letters", semantics="tok", attributes=payload("3x")), alert("new", semantics="never", attributes=payload("11")),
    ]
    assert decisions(spark, learnt, tested) == {
        "exact": ("filter", "verified_benign_exact_match"), "net": ("filter", "verified_benign_generalized_match"),
        "far": ("forward", "hat_path_not_found:source_entity"), "digits": ("filter", "verified_benign_generalized_match"),
        "letters": ("forward", "hat_path_not_found:attribute_template"), "new": ("forward", "hat_path_not_found:alert_semantics"),
    }
    assert decisions(spark, learnt[:1], tested[:1], least_support=2) == {"exact": ("forward", "insufficient_support")}


def test_expired_inactive_and_protected(spark, tmp_path):
    prints = memory.learn(raw(spark, [alert("1")]), expires_at=T0)
    decide = lambda p: memory.decide(raw(spark, [alert("x")]), p, now=T0).first().reason
    assert decide(prints) == "expired_fingerprint"
    assert decide(prints.withColumn("active", F.lit(False))) == "inactive_fingerprint"
    meta = aggregated(spark, [alert("a", 0, "login fail"), alert("b", 5, "login fail")])
    assert memory.decide(meta, memory.learn(meta)).first().reason == "protected_high_frequency_behavior:brute_force"
    memory.save_memory(prints, str(tmp_path / "m"))
    assert memory.load_memory(spark, str(tmp_path / "m")).select("digest").count() == 1
    with pytest.raises(PySparkException):
        memory.save_memory(prints, str(tmp_path / "m"))


def test_retrieval_cuts_at_the_threshold(spark):
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.71), ("c", 0.69)], "pattern_id string, x double").selectExpr("pattern_id", "'s' AS bucket", "array(x, sqrt(1 - x * x)) AS embedding")
    asked = spark.sql("SELECT 'q' AS query_id, 's' AS bucket, array(1.0D, 0.0D) AS embedding")
    assert [r.entry_id for r in knowledge.retrieve(asked, rows).orderBy("rank").collect()] == ["a", "b"]


def test_allocation_by_largest_remainder(spark):
    rows = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)], "s string")
    # shares 1.4, 0.4, 0.2: one whole row, and the one left goes to the first of the equal remainders
    assert {r.s: r["take"] for r in knowledge.stratified_allocation(rows, ["s"], 0.2).collect()} == {"a": 2, "b": 0, "c": 0}


def test_leaders_not_members_decide(spark):
    rows = spark.createDataFrame([(1, "k", "a b c d"), (2, "k", "a b c e"), (3, "k", "b c e f")], "id int, k string, t string")
    got = {r.id: r.leader for r in knowledge.leader_clusters(rows, ["k"], ["id"], "id", "t", 0.3).collect()}
    assert got == {1: "1", 2: "1", 3: "3"}


def test_leaders_in_rounds_equal_the_sequential_fold(spark):
    words = "a b c d e f g".split()
    texts = [" ".join(words[(i * k + k) % 7] for k in range(1, 3 + i % 4)) for i in range(60)]
    rows = [(i, None if i % 3 else "k", t) for i, t in enumerate(texts)]
    leaders, want = {}, {}
    for i, k, t in rows:
        words = t.split()
        sig = {*words, *map("::".join, zip(words, words[1:], strict=False))}
        scored = [(len(sig & s) / len(sig | s), -at) for at, s in leaders.setdefault(k, {}).items()]
        best, at = max(scored, default=(0, 0))
        if best < 0.4:
            leaders[k][i], best, at = sig, 1.0, -i
        want[i] = (str(-at), best)
    assert sum(map(len, leaders.values())) > 6
    frame = spark.createDataFrame(rows, "id int, k string, t string")
    got = knowledge.leader_clusters(frame, ["k"], ["id"], "id", "t", 0.4, batch=3).collect()
    assert {r.id: (r.leader, r.similarity) for r in got} == want


def test_alias_groups(spark):
    rows = frame(spark, [alert("a", semantics="X one"), alert("b", semantics="y two"), alert("c", semantics="z")])
    got = {r.alert_id: r.bucket for r in knowledge.with_alias_group(rows, {"g": ["x one", "Y two"]}).collect()}
    assert got == {"a": "g", "b": "g", "c": "z"}
    with pytest.raises(ValueError):
        knowledge.with_alias_group(rows, {"g": ["x"], "h": ["X"]})


@pytest.mark.parametrize(
    ("text", "label", "code"),
    [
        ('```json\n{"label":"false_positive","supporting":["k"],"confidence":0.5}\n```', "false_positive", None),
        ("nonsense", "needs_review", "invalid_json"),
        ('{"label":"maybe"}', "needs_review", "invalid_label"),
        ('{"label":"true_attack","confidence":2}', "needs_review", "invalid_confidence"),
        ('{"label":"true_attack","supporting":["zz"]}', "needs_review", "unknown_ids"),
        ('{"label":"true_attack","supporting":["k"],"contradicting":["k"]}', "needs_review", "overlapping_ids"),
    ],
)
def test_verdicts_are_read_strictly(text, label, code):
    got = adjudicate.read_verdict(text, {"k"})
    assert (got["label"], got["error_code"]) == (label, code)


def test_a_failing_provider_needs_review(spark):
    def fails(prompt):
        raise OSError("down")

    asked = spark.sql("SELECT 'a' AS object_id, '{}' AS prompt, array('k') AS allowed")
    assert adjudicate.adjudicate(asked, fails, retries=1, backoff=0).first().error_code == "provider_failed"


def test_fit_takes_one_of_three(spark):
    rows = frame(spark, [alert("a", 5), alert("b", 1), alert("c", 9)]).withColumn("label", F.lit("benign"))
    learnt, rest = split_fit(rows, 0.2)
    assert [r.alert_id for r in learnt.collect()] == ["b"] and rest.count() == 2
