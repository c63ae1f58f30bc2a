"""Scalar expressions on text, hashes, addresses and vectors; all of them built-in."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions import markers as M


def clean(value: Column) -> Column:
    """Text without white space at its ends; blank text is null. Only texts that begin or end with it go through the pattern."""
    text = value.cast("string")
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.nullif(F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text), F.lit(""))


def squeezed(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def stable_id(prefix: str, material: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(material, 256), 1, digits))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex((variant.bitwiseAND(3)).bitwiseOR(8))), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def count_bucket(n: Column) -> Column:
    return F.when(n < 2, "0-1").when(n < 10, "2-9").when(n < 100, "10-99").when(n < 1000, "100-999").otherwise("1000+")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 60, "<1m").when(seconds < 300, "1-5m").when(seconds < 3600, "5-60m").otherwise("60m+")


def rate_bucket(n: Column, seconds: Column) -> Column:
    rate = n * 60.0 / F.greatest(seconds.cast("double"), F.lit(1.0))
    return F.when(rate < 1, "<1/min").when(rate < 10, "1-10/min").when(rate < 100, "10-100/min").otherwise("100+/min")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the lower-cased characters."""
    low = F.lower(text)
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(low, c, F.lit("")))) / n)
    bits = F.aggregate(F.array_sort(parts), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def _labels(name: Column) -> Column:
    return F.filter(F.split(name, r"\."), lambda p: p != "")


def base_domain(name: Column) -> Column:
    """The last two labels of a DNS name, lower-cased."""
    labels = F.transform(_labels(name), lambda p: F.lower(p))
    return F.when(F.size(labels) < 2, F.lower(name)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def encoded_dns_name(name: Column) -> Column:
    """Whether a name looks like data carried in DNS labels."""
    labels = _labels(name)
    longest = F.aggregate(labels, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    compact = F.regexp_replace(longest, "[^A-Za-z0-9+/=_*-]", "")
    control = F.try_element_at(labels, F.lit(1)).rlike(M.TUNNEL_CONTROL) & F.try_element_at(labels, F.lit(2)).rlike(M.TUNNEL_SEQUENCE)
    dense = (F.length(name) >= 80) & (F.length(compact) >= 32) & (entropy(compact) >= 3.5)
    long = (F.length(name) >= 120) & (F.length(compact) >= 24)
    return F.coalesce((F.size(labels) >= 3) & (F.coalesce(control, F.lit(False)) | dense | long), F.lit(False))


_BYTE = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = F.split(text, r"\.")
    value = reduce(lambda a, i: a * 256 + F.try_element_at(p, F.lit(i)).try_cast("long"), range(1, 5), F.lit(0).cast("long"))
    return F.when(is_ipv4(text), value)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_subnet(text: Column, bits: int) -> Column:
    """The subnet that holds an IPv4 address; other text stays."""
    mask = ((1 << bits) - 1) << (32 - bits)
    return F.when(is_ipv4(text), F.concat(ipv4_text(ipv4_number(text).bitwiseAND(mask)), F.lit(f"/{bits}"))).otherwise(text)


def cidr_contains(network: Column, address: Column) -> Column:
    """Whether an IPv4 network a.b.c.d/n holds an address; false for text that is neither."""
    bits = F.regexp_extract(network, r"/(\d+)$", 1).try_cast("int")
    base = ipv4_number(F.regexp_extract(network, r"^([^/]+)/", 1))
    shift = F.lit(32) - bits
    same = F.call_function("shiftright", base, shift) == F.call_function("shiftright", ipv4_number(address), shift)
    return F.coalesce(bits.between(0, 32) & same, F.lit(False))


def key_placeholder(key: Column) -> Column:
    """The mask that a key alone decides: token before time, id and number; null for other keys."""
    masks = [F.when(F.lower(key).rlike(f"\\A{pattern}\\z"), mask) for mask, pattern in M.KEY_RULES]
    return F.coalesce(*masks)


def canonical_values(values: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; blanks and nulls go."""
    low = F.transform(values, lambda v: F.lower(clean(v)))
    return F.array_sort(F.array_distinct(F.filter(low, lambda v: v.isNotNull())))


def service_protocols(services: Column) -> Column:
    """Protocol names found in service texts."""
    parts = F.flatten(F.transform(services, lambda s: F.split(F.lower(s), r"(?U)[/:\s]+")))
    return canonical_values(F.filter(parts, lambda p: p.isin(*M.PROTOCOLS)))


def payload_signature(template: Column) -> Column:
    """Set of lower-cased tokens and of neighbouring pairs of them."""
    tokens = F.transform(F.regexp_extract_all(template, F.lit(M.SIGNATURE_TOKEN), F.lit(0)), lambda t: F.lower(t))
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat_ws("::", a, b)
    )
    return F.when(F.size(tokens) > 0, F.array_distinct(F.concat(tokens, pairs))).otherwise(F.array(F.lit("<empty-payload>")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def normalized_vector(v: Column) -> Column:
    """The unit vector; null where a component isn't finite or all are zero. The length is an argument, so it isn't computed again for each component."""
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    unit = lambda length: F.when(usable & (length > 0), F.transform(v, lambda x: x.cast("double") / length))
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), unit), 1)


def character_shape(text: Column) -> Column:
    """Which of lower, upper, digit and other characters a text has, as letters ludp."""
    shape = F.concat(
        F.when(text.rlike(r"(?U)\p{Lower}"), "l").otherwise(""),
        F.when(text.rlike(r"(?U)\p{Upper}"), "u").otherwise(""),
        F.when(text.rlike(r"(?U)\d"), "d").otherwise(""),
        F.when(text.rlike(r"(?U)[^\p{L}\p{N}]"), "p").otherwise(""),
    )
    return F.when(shape == "", "empty").otherwise(shape)


def final_label(time_label: Column, event_label: Column) -> Column:
    """Outside an attack window benign, inside without an event false_positive, else the event."""
    return F.when(time_label.startswith("false_positive"), "benign").when(event_label != "-", event_label).otherwise("false_positive")
