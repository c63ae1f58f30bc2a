"""Scalar functions and masks, with values worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from alertloom.functions import shapes
from alertloom.functions import text as T
from alertloom.functions.templates import mask_text, masked, masked_native, template


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM", "<JWT>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 x", "id <UUID> x"),
        ("00:1a:2b:3c:4d:5e", "<MAC>"),
        ("mail a.b@example.com now", "mail <EMAIL> now"),
        ("at 2024-01-02T03:04:05Z ok", "at <TIMESTAMP> ok"),
        ("[10/Oct/2023:13:55:36 +0200]", "[<TIMESTAMP>]"),
        ("Mon, 02 Jan 2006 15:04:05 GMT", "<TIMESTAMP>"),
        ("Jan 12 06:25:01 host sshd[4242]:", "<TIMESTAMP> host sshd[<PID>]:"),
        ("from 10.0.0.1 port 55555", "from <IPV4> port 55555"),
        ("fe80::1ff:fe23:4567:890a", "<IPV6>"),
        ("x" + " " + "a" * 64, "x <SHA256>"),
        ("d41d8cd98f00b204e9800998ecf8427e", "<MD5>"),
        ("n 1234567 m 12345", "n <NUMBER> m 12345"),
        ("/a?session=abc&x=1", "/a?session=<TOKEN>&x=1"),
        ("a%20b=1", "a b=1"),
        ("QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "<TOKEN>"),
        ("/var/www/html/index/pages/list", "/var/www/html/index/pages/list"),
        ("ｆｕｌｌ  width", "full width"),
    ],
)
def test_masks(text, expected):
    assert mask_text(text) == expected


def test_native_masks_agree_on_plain_text(spark):
    texts = ["from 10.0.0.1 at 2024-01-02 03:04:05", "sshd[77] user a@b.example id 1234567", "aGVsbG8gd29ybGQgaGVsbG8gMTIz", "x 12345"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(masked(F.col("t")).alias("a"), masked_native(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_templates():
    exact = template('{"payload_fields": {"url": "/a%20b  c", "id": 5, "none": "", "list": ["x"]}}', False)
    assert exact == '{"id":5,"list":["x"],"url":"/a%20b c"}'
    assert template('{"payload_fields": {"url": "/a%20b", "id": 5}}', True) == '{"id":"<ID>","url":"/a b"}'
    assert template(None, True) == template("{}", True) == ""
    assert template('{"payload": "x 1234567", "other": 1}', True) == '{"payload":"x <NUMBER>"}'
    long = template('{"payload_fields": {%s}}' % ",".join(f'"k{i}": "{"v" * 4000}"' for i in range(6)), False)
    assert '"truncated":true' in long and len(long) < 20000


def test_ids_and_addresses(spark):
    assert one(spark, T.uuid5(F.col("n")), n="abc") == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert one(spark, T.ipv4_subnet(F.col("n"), 24), n="10.1.2.3") == "10.1.2.0/24"
    assert one(spark, T.ipv4_subnet(F.col("n"), 24), n="host") == "host"
    assert one(spark, T.cidr_contains(F.lit("10.0.0.0/8"), F.col("n")), n="10.9.9.9")
    assert not one(spark, T.cidr_contains(F.lit("10.0.0.0/8"), F.col("n")), n="11.0.0.1")
    assert not one(spark, T.cidr_contains(F.lit("nonsense"), F.col("n")), n="11.0.0.1")


def test_dns_names(spark):
    tunnel = "12x3-.4-.data.example.com"
    dense = "abcdefghijklmnopqrstuvwxyz0123456789" + "." + "q" * 45 + ".t.example.com"
    assert one(spark, T.encoded_dns_name(F.col("n")), n=tunnel)
    assert one(spark, T.encoded_dns_name(F.col("n")), n="z" * 60 + "." + "y" * 50 + ".example.com")
    assert not one(spark, T.encoded_dns_name(F.col("n")), n="www.example.com")
    assert one(spark, T.base_domain(F.col("n")), n=dense) == "example.com"
    assert one(spark, T.entropy(F.col("n")), n="aabb") == pytest.approx(1.0)


def test_signature_and_vectors(spark):
    assert sorted(one(spark, T.payload_signature(F.col("n")), n="GET /a <ID>")) == ["/a" * 0 + "<id>", "a", "a::<id>", "get", "get::a"]
    assert one(spark, T.payload_signature(F.col("n")), n="") == ["<empty-payload>"]
    assert one(spark, T.normalized_vector(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, T.normalized_vector(F.array(F.lit(0.0)))) is None
    for t, e, want in (("outside", "-", "false_positive"), ("false_positive", "x", "benign"), ("a", "scan", "scan")):
        assert one(spark, T.final_label(F.col("t"), F.col("e")), t=t, e=e) == want


def learn_layer(layer, candidate, values):
    """shapes.assembled over the groups that Spark would make."""
    groups = {}
    for value in dict.fromkeys(values):
        for x in shapes.observed(layer, candidate, value):
            groups.setdefault(x[:3], []).append(x)
    made = [
        shapes.Group(*k, len(g), min((x.kind, x.text) for x in g), max((x.kind, x.text) for x in g), all(x.fits for x in g), list({x.shape for x in g}))
        for k, g in groups.items()
    ]
    return shapes.assembled(layer, candidate, len(set(values)), made)


@pytest.mark.parametrize(
    ("candidate", "values", "learnt"),
    [
        ('{"a":"<ID>"}', ['{"a":1}', '{"a":"x2"}'], ('{"a":"<ID>"}', [("<ID>", ["id:d", "id:ld"])], True)),
        ('{"a":"<ID>","b":"k <NUMBER> v <NUMBER>"}', ['{"a":[1],"b":"k 12 v 7"}', '{"a":[1],"b":"k 13 v 7"}'],
         ('{"a":[1],"b":"k <NUMBER> v 7"}', [("<NUMBER>", ["number:digits"])], True)),
        ('{"a":["<IPV4>",{"b":"<TOKEN>"}]}', ['{"a":["10.0.0.1",{"b":"x"}]}', '{"a":["10.0.0.2",{"b":"Y"}]}'],
         ('{"a":["<IPV4>",{"b":"<TOKEN>"}]}', [("<IPV4>", ["ipv4"]), ("<TOKEN>", ["token:l", "token:u"])], True)),
        ('{"a":"<ID>"}', ['{"a":1}', '{"a":1,"b":2}'], None),
        ('{"a":"<ID>"}', ['{"a":null}', '{"a":1}'], None),
        ('{"a":"<IPV4>"}', ['{"a":"10.0.0.1"}', '{"a":"x"}'], None),
        ('{"a":{"c":"<ID>"}}', ['{"a":{"c":1,"d":0}}', '{"a":{"c":2,"d":0}}'], None),
        ("n <NUMBER>", ["n 1", "n 2"], ("n <NUMBER>", [("<NUMBER>", ["number:digits"])], True)),
        ("n <NUMBER>", ["n 1", "m 2"], None),
        ('{"a":1}', ['{"a":1}'], ('{"a":1}', [], False)),
    ],
)
def test_patterns_are_learnt_by_place(candidate, values, learnt):
    assert learn_layer("attribute_template", candidate, values) == learnt
    if learnt:
        rules = [(i, m, s) for i, (m, s) in enumerate(learnt[1])]
        assert all(shapes.layer_matches("attribute_template", learnt[0], v, rules) for v in values)
    assert not shapes.layer_matches("attribute_template", '{"a":"<ID>"}', '{"a":{"b":1}}', [(0, "<ID>", ["id:l"])])


def test_placeholders_are_typed():
    assert shapes.capture("a <ID> b <NUMBER>", "a x1 b 77") == [("<ID>", "x1"), ("<NUMBER>", "77")]
    assert shapes.capture("<ID><NUMBER>", "x7") is None
    assert shapes.capture("a<ID>", "a") is None
    assert shapes.shape("<TIMESTAMP>", "2024-01-01") == "timestamp:iso" and shapes.shape("<TOKEN>", "aB1-") == "token:ludp"
    assert shapes.fits("<IPV4>", "10.0.0.1") and not shapes.fits("<IPV4>", "::1") and not shapes.fits("<NUMBER>", "x")
    learnt = learn_layer("attribute_template", '{"p":"u <NUMBER>"}', ['{"p":"u 1234567"}', '{"p":"u 7654321"}'])
    assert learnt == ('{"p":"u <NUMBER>"}', [("<NUMBER>", ["number:digits"])], True)
    assert learn_layer("target_entity", "10.0.0.0/24", ["10.0.0.1", "10.0.0.2"]) == ("10.0.0.0/24", [], True)
    assert learn_layer("target_entity", "10.0.0.0/24", ["10.0.0.1", "10.0.1.2"]) is None
    assert learn_layer("service_information", "x", ["x", "y"]) is None
    rules = [(0, "<TOKEN>", ["token:d"])]
    assert shapes.layer_matches("service_information", "t <TOKEN>", "t 123", rules)
    assert not shapes.layer_matches("service_information", "t <TOKEN>", "t 12a", rules)
