"""Synthetic labelled records: seeded values, templates rendered with offsets, contrast pairs, log wrappers. All of it is a function of (seed, id), so any
partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import luhn_check_digit, mod97
from ..schema import LABELS


def draw(n: Column | int, *parts: Column) -> Column:
    """A whole number from 0 to n - 1, from the SHA-256 of the parts."""
    joined = F.concat_ws("\0", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def _digits(k: int, *parts: Column) -> Column:
    return F.lpad(draw(10**k, *parts).cast("string"), k, "0")


def _pick(values: list[str], *parts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(len(values), *parts) + 1).cast("int"))


# Areas that no social security number has, and documentation networks and domains.
SSN_AREAS = ["000", "666", "900", "950", "987"]
DOMAINS = ["example.test", "mail.invalid", "corp.example"]
SYLLABLES = ["ba", "dor", "fe", "gul", "hen", "ki", "lom", "mar", "nis", "pol", "quo", "ros", "sti", "tru", "ven", "zor"]


def word(*parts: Column) -> Column:
    return F.concat(*[_pick(SYLLABLES, *parts, F.lit(f"syllable{i}")) for i in range(3)])


def value_for(label: Column, key: Column, seed: int) -> Column:
    """A value of a label for a key: shaped like the real thing, from ranges that are never given out."""
    p = (F.lit(seed), label, key)
    d = lambda k, tag: _digits(k, *p, F.lit(tag))
    name = F.concat(F.initcap(word(*p, F.lit("given"))), F.lit(" "), F.initcap(word(*p, F.lit("family"))))
    card = F.concat(F.lit("4"), d(14, "card"))
    bban = F.concat(F.lit("TEST"), d(14, "iban"))
    check = F.lpad((98 - mod97(F.concat(bban, F.lit("GB00")))).cast("string"), 2, "0")
    r = [d(1, f"r{i}").cast("int") for i in range(8)]
    routing = F.concat(*[x.cast("string") for x in r], ((10 - (3 * (r[0] + r[3] + r[6]) + 7 * (r[1] + r[4] + r[7]) + r[2] + r[5]) % 10) % 10).cast("string"))
    values = {
        "PERSON_NAME": name, "EMAIL": F.concat(word(*p), F.lit("."), d(3, "mail"), F.lit("@"), _pick(DOMAINS, *p)), "PHONE": F.concat(F.lit("+1 "), d(3, "area"), F.lit(" 555 01"), d(2, "line")),
        "SSN": F.concat(_pick(SSN_AREAS, *p), F.lit("-"), d(2, "g"), F.lit("-"), d(4, "s")), "ITIN": F.concat(F.lit("9"), d(2, "a"), F.lit("-7"), d(1, "b"), F.lit("-"), d(4, "c")), "TAX_ID": F.concat(d(2, "x"), F.lit("-"), d(7, "y")),
        "CREDIT_CARD_NUMBER": F.concat(card, luhn_check_digit(card).cast("string")), "ROUTING_NUMBER": routing, "IBAN": F.concat(F.lit("GB"), check, bban), "BANK_ACCOUNT_NUMBER": d(10, "acc"), "SWIFT_BIC": F.concat(F.lit("TEST"), F.upper(F.substring(word(*p), 1, 4))),
        "BUSINESS_ID": F.concat(_pick(["ORD", "TX", "RQ"], *p), d(10, "b")), "PASSPORT_NUMBER": F.concat(F.lit("X"), d(8, "p")), "DRIVER_LICENSE": F.concat(F.lit("D"), d(7, "l")), "IP_ADDRESS": F.concat(F.lit("198.51.100."), draw(254, *p, F.lit("ip")).cast("string")),
        "DEVICE_ID": F.concat(F.lit("dev-"), d(10, "dev")), "AUTH_TOKEN": F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws("|", *[x.cast("string") for x in p]), 256), 1, 32)),
        "API_KEY": F.concat(F.lit("key_"), F.substring(F.sha2(F.concat_ws("/", *[x.cast("string") for x in p]), 256), 1, 24)), "DOB": F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), draw(18000, *p).cast("int")), "yyyy-MM-dd"), "AGE": (draw(80, *p) + 18).cast("string"),
        "STREET_ADDRESS": F.concat(d(3, "no"), F.lit(" "), F.initcap(word(*p)), F.lit(" Street")), "CITY": F.initcap(word(*p, F.lit("city"))), "STATE_PROVINCE": F.initcap(word(*p, F.lit("state"))), "POSTAL_CODE": d(5, "zip"), "COUNTRY": F.initcap(word(*p, F.lit("land"))),
    }
    out = None
    for k, v in values.items():
        out = F.when(label == k, v) if out is None else out.when(label == k, v)
    return out.otherwise(d(8, "other"))


#: Written forms of the values of a label: cut (lengths of the groups of its digits) and joint.
MORPHOLOGIES = {
    "SSN": {"dashed": ((3, 2, 4), "-"), "spaced": ((3, 2, 4), " "), "dotted": ((3, 2, 4), "."), "plain": ((9,), "")}, "ITIN": {"dashed": ((3, 2, 4), "-"), "spaced": ((3, 2, 4), " "), "plain": ((9,), "")},
    "CREDIT_CARD_NUMBER": {"plain": ((16,), ""), "spaced": ((4, 4, 4, 4), " "), "dashed": ((4, 4, 4, 4), "-")}, "BANK_ACCOUNT_NUMBER": {"plain": ((10,), ""), "dashed": ((4, 6), "-")},
    "ROUTING_NUMBER": {"plain": ((9,), ""), "spaced": ((4, 4, 1), " ")}, "TAX_ID": {"dashed": ((2, 7), "-"), "plain": ((9,), "")},
}


def formed(label: str, value: Column, morphology: str) -> Column:
    """A value in one of the written forms of its label: its digits grouped anew."""
    cut, joint = MORPHOLOGIES[label][morphology]
    digits, at, parts = F.regexp_replace(value, "[^0-9]", ""), 1, []
    for n in cut:
        parts.append(F.substring(digits, at, n))
        at += n
    return F.concat_ws(joint, *parts)


def noise_value(kind: Column, key: Column, seed: int) -> Column:
    """What looks like a value of some label and is none: version, build, order, ticket, trace, batch, service account, request."""
    p = (F.lit(seed), kind, key)
    d = lambda k, tag: _digits(k, *p, F.lit(tag))
    hexes = F.sha2(F.concat_ws("~", *[x.cast("string") for x in p]), 256)
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.concat(F.lit("4"), F.substring(hexes, 14, 3)), F.concat(F.lit("8"), F.substring(hexes, 18, 3)), F.substring(hexes, 21, 12))
    quad = F.concat_ws(".", *[draw(n, *p, F.lit(f"v{i}")).cast("string") for i, n in enumerate((9, 40, 200, 250))])
    values = {
        "version": quad, "build": F.concat_ws(".", d(3, "b"), d(3, "c"), d(4, "d")), "order": F.concat_ws("-", d(3, "o"), d(2, "p"), d(4, "q")), "ticket": d(9, "t"), "trace": F.substring(hexes, 1, 32), "batch": d(10, "n"),
        "service": F.concat(word(*p, F.lit("svc")), F.lit("-"), _pick(["api", "worker", "relay"], *p)), "request": uuid,
    }
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


NOISE = ("version", "build", "order", "ticket", "trace", "batch", "service", "request")
#: Surface styles: how a key and its value are written, with {KEY} and {VALUE}.
SURFACES = {
    "key_equals": "{KEY}={VALUE}", "key_colon": "{KEY}: {VALUE}", "json_flat": '{"{KEY}":"{VALUE}"}', "json_nested": '{"event":{"{KEY}":"{VALUE}"}}', "structured_audit": "audit [{KEY}] value [{VALUE}] recorded", "query": "GET /find?{KEY}={VALUE}&page=1",
    "csv_row": "{KEY},{VALUE},ok", "plain": "the {KEY} {VALUE} was seen",
}
STYLES = ("json", "kv", "syslog", "bracketed", "csv", "plain")
QUIET = ("job {version} finished without findings", "cache warmed in time", "queue drained, nothing left", "rotation of keys done")


def surface(style: str, key: str, place: str) -> str:
    return SURFACES[style].replace("{KEY}", key).replace("{VALUE}", place)


def catalog(spark: SparkSession) -> DataFrame:
    """(template_family, template, style, kind): positive templates of all labels in all surface styles, hard negatives (look-alikes in the same styles) and quiet ones. A catalogue of fixed size, in order of family."""
    rows = [(f"positive_{x.lower()}_{s}", surface(s, x.lower(), f"{{{x}}}"), STYLES[(i + j) % len(STYLES)], "positive") for i, x in enumerate(LABELS) for j, s in enumerate(SURFACES)]
    rows += [(f"negative_{k}_{s}", surface(s, f"{k}_ref", f"{{{k}}}"), STYLES[(i + j) % len(STYLES)], "hard_negative") for i, k in enumerate(NOISE) for j, s in enumerate(SURFACES)]
    rows += [(f"quiet_{i}", x, STYLES[i % len(STYLES)], "negative") for i, x in enumerate(QUIET)]
    return spark.createDataFrame(sorted(rows), "template_family string, template string, style string, kind string")


def render(template: Column, values: Column) -> Column:
    """struct(text, spans) of a template whose {LABEL} places take the values of a map and whose {noise} places, in small letters, take theirs without a span; a place without value stays as it stands.
    Offsets are counted while the pieces are joined."""
    pieces = F.regexp_extract_all(template, F.lit(r"(\{[A-Za-z_]+\}|[^{]+|\{)"), F.lit(1))
    span = "array<struct<span_start:int,span_end:int,label:string>>"

    def step(acc: Column, piece: Column) -> Column:
        label = F.regexp_extract(piece, r"^\{([A-Za-z_]+)\}$", 1)
        value = F.try_element_at(values, label)
        at = F.length(acc["text"])
        filled = F.concat(acc["spans"], F.array(F.struct(at.alias("span_start"), (at + F.length(value)).alias("span_end"), label.alias("label"))))
        return F.struct(F.concat(acc["text"], F.coalesce(value, piece)).alias("text"), F.when(value.isNull() | ~label.rlike("^[A-Z_]+$"), acc["spans"]).otherwise(filled).cast(span).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit("").alias("text"), F.array().cast(span).alias("spans")), step)


def wrap(style: Column, text: Column, at: Column) -> Column:
    """A log line of a style around a message."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_900_000_000) + at * 37), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(style == "json", F.concat(F.lit('{"ts":"'), stamp, F.lit('","msg":"'), text, F.lit('"}'))).when(style == "kv", F.concat(F.lit("ts="), stamp, F.lit(" msg='"), text, F.lit("'")))
        .when(style == "syslog", F.concat(stamp, F.lit(" host app[1]: "), text)).when(style == "bracketed", F.concat(F.lit("["), stamp, F.lit("] "), text))
        .when(style == "csv", F.concat(stamp, F.lit(',"'), text, F.lit('"'))).otherwise(text)
    )


def generate(spark: SparkSession, templates: DataFrame, rows: int, seed: int = 42, start: int = 0) -> DataFrame:
    """(record_idx, template_family, text, entities): records from templates(template_family, template, style), in turn, numbered from `start`. Values depend on the seed and the record only."""
    n = templates.count()
    numbered = templates.selectExpr("*", "row_number() over (order by template_family) - 1 as slot")
    base = spark.range(start, start + rows).select(F.col("id").alias("record_idx"), F.pmod("id", F.lit(n)).alias("slot")).join(F.broadcast(numbered), "slot")  # templates are a catalogue of bounded size
    places = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{([A-Za-z_]+)\}"), F.lit(1)))
    known = F.filter(places, lambda x: x.isin(*LABELS, *NOISE))
    values = F.map_from_entries(F.transform(known, lambda x: F.struct(x, F.coalesce(F.when(x.isin(*NOISE), noise_value(x, F.col("record_idx"), seed)), value_for(x, F.col("record_idx"), seed)))))
    made = base.withColumn("r", render(F.col("template"), values))
    whole = wrap(F.col("style"), F.col("r.text"), F.col("record_idx"))
    shift = F.instr(whole, F.col("r.text")) - 1
    moved = F.transform("r.spans", lambda s: F.struct((s["span_start"] + shift).alias("span_start"), (s["span_end"] + shift).alias("span_end"), s["label"].alias("label")))
    return made.select("record_idx", "template_family", whole.alias("text"), moved.alias("entities"))


def unlabeled(spark: SparkSession, rows: int, seed: int = 42, start: int = 1_000_000) -> DataFrame:
    """generate over the templates without labels: raw negatives, numbered from `start` so that they meet no labelled record."""
    return generate(spark, catalog(spark).where("kind <> 'positive'").drop("kind"), rows, seed, start)


def contrast_pairs(spark: SparkSession, families: DataFrame, seed: int = 42) -> DataFrame:
    """Two records for each (family, pair): one value in a sensitive and in a harmless role. families(family, label, pairs, sensitive, harmless), the last two templates with {FOCUS}.

    Gives (contrast_group_id, family, context_role, text, entities, target) where target has offsets, the expected label (O in the harmless role) and the value's SHA-256."""
    p = families.select("*", F.explode(F.sequence(F.lit(1), F.col("pairs"))).alias("pair"))
    group = F.concat_ws(":", "family", F.col("pair").cast("string"))
    p = p.withColumn("contrast_group_id", group).withColumn("value", value_for(F.col("label"), F.col("contrast_group_id"), seed))
    roles = F.array(F.struct(F.lit("sensitive").alias("role"), F.col("sensitive").alias("t"), F.col("label").alias("x")), F.struct(F.lit("harmless").alias("role"), F.col("harmless").alias("t"), F.lit("O").alias("x")))
    p = p.select("contrast_group_id", "family", "value", F.explode(roles).alias("r")).withColumn("d", render(F.col("r.t"), F.create_map(F.lit("FOCUS"), F.col("value"))))
    s = F.get("d.spans", 0)
    target = F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), F.col("r.x").alias("expected_label"), F.lit("focus").alias("target_role"), F.sha2("value", 256).alias("value_sha256"))
    entities = F.when(F.col("r.x") == "O", F.array()).otherwise(F.transform("d.spans", lambda z: F.struct(z["span_start"], z["span_end"], F.col("r.x").alias("label"))))
    return p.select("contrast_group_id", "family", F.col("r.role").alias("context_role"), F.col("d.text").alias("text"), entities.cast("array<struct<span_start:int,span_end:int,label:string>>").alias("entities"), target.alias("target"))
