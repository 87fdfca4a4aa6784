"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are values that match strict patterns: email, ip, card, phone, and long hexadecimal secrets. Candidates are
tokens that carry digits or an at sign, and runs of number groups. Each candidate has lexical patterns made of the
words around it: two words before, the word before, that with the word after, and that with the candidate's shape. In the graph of patterns and instances, a pattern is scored for each kind by the share of its occurrences
that are instances of the kind, and an instance by the confident patterns that hold it; rounds go on until nothing
changes. Confident patterns with enough different seeds then discover candidates that no strict pattern knows and
that are written as values of the kind can be, as ``found_`` and the kind. Secrets and found spans are added; the base spans of the four kinds stay.

Defined results: a null text counts as empty (no spans); repeated rows give repeated rows with equal spans and count
once as occurrences; documents are told apart by id and a 128-bit hash of the text, so a repeated or null id with
different texts is handled; an empty table gives no row; extra columns, whatever their names, are ignored by
``find`` and kept by ``redact``. Time is linear in the length of a text and in the number of its matches.

Positions: splitting a text by the same pattern gives the gaps before its matches; a running sum over the matches
of a document adds up to their places. Quantifiers over groups are possessive and starts are anchored to the run that
they begin, which changes no match but keeps the time linear and the stack flat on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, part_listed, texts_of

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: (pattern, what a text must contain for it)
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+){3}", "."),
    "card": (r"[0-9](?:[ -]?[0-9])++", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_EDGE = r"""\s"'<>"""
_MARKS = rf"[^{_EDGE}\p{{L}}0-9@]*+"
#: One group of a number, when only punctuation stands between it and the next white space or quote.
_GROUP = rf"[+(]?[0-9][0-9().+/-]*+(?={_MARKS}(?:[{_EDGE}]|\z))"
#: Candidates: runs of number groups, or tokens that carry a digit or an at sign.
CANDIDATE = rf"(?:(?<![^{_EDGE}])|\G)(?:{_GROUP}(?: {_GROUP})*+{_MARKS}|[^{_EDGE}0-9@]*+[0-9@][^{_EDGE}]*+)"
#: A candidate can be an identifier when it has an at sign within, or so many digits.
LEAST_DIGITS = 4
#: Strict seeds of the added kind: long hexadecimal values with digits and letters.
SECRET = r"\A(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+\z"
KINDS = [*BASE, "secret"]
#: A pattern discovers when its score and its number of different seed instances reach these.
CONFIDENCE, SEEDS = 0.9, 5
#: Rounds after which the graph must have settled; scores only rise, so they end by themselves.
MAX_ROUNDS = 30
#: Code points of a piece of a text that is redacted at once.
CHUNK = 4096

_KEY = ["doc_id", "text_key"]


def _matches(text: Column, pattern: str, need: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(need), found).otherwise(F.array().cast("array<string>")) if need else found


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _words(gap: Column) -> Column:
    """Letters, digits, equals signs and colons of a gap, in lower case, with single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(gap), r"[^\p{L}\p{N}=:]++", " "))


def _luhn(value: Column) -> Column:
    digits = F.transform(F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    twice = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]++", ""))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z")
    if kind == "card":
        return F.when(_digits(value).between(16, 19), _luhn(value)).otherwise(False)
    return _digits(value).between(8, 15) if kind == "phone" else F.lit(True)


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind (of BASE, or candidate), i, start, end, value, left and right (words of candidates).

    Only matches travel, not texts; equal rows count once.
    """
    text = F.col("text")
    patterns = {k: p for k, (p, _) in BASE.items()} | {"candidate": CANDIDATE}
    need = {k: n for k, (_, n) in BASE.items()} | {"candidate": ""}
    rows = docs.select("doc_id", "text", _key(text).alias("text_key"), *[_matches(text, p, need[k]).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select(*_KEY, *[f"m_{k}" for k in patterns], *[F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).alias(f"g_{k}") for k, p in patterns.items()])

    def listed(kind: str) -> Column:
        words = kind == "candidate"

        def one(z: Column, i: Column) -> Column:
            gap, none = z["gap"], F.lit(None).cast("string")
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("skip"), z["value"].alias("value"),
                (F.substring_index(_words(F.substring_index(gap, " ", -5)), " ", -2) if words else none).alias("left"),
                (F.substring_index(_words(F.substring_index(gap, " ", 5)), " ", 1) if words else none).alias("head"),
            )

        zipped = F.transform(F.arrays_zip(F.col(f"g_{kind}").alias("gap"), F.col(f"m_{kind}").alias("value")), one)
        kinds = "array<struct<kind:string,i:int,skip:int,value:string,left:string,head:string>>"
        return F.coalesce(zipped, F.array()).cast(kinds)

    rows = rows.select(*_KEY, F.explode(F.concat(*map(listed, patterns))).alias("m"))
    rows = rows.select(*_KEY, "m.*").distinct()
    order = Window.partitionBy(*_KEY, "kind").orderBy("i")
    size = F.coalesce(F.length("value"), F.lit(0))
    end = F.sum(F.col("skip") + size).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.select(*_KEY, "kind", "i", end.alias("end"), "value", "left", F.lead("head").over(order).alias("right"))
    # The gap after the last match has no value; it was kept for the word that it begins with.
    return rows.where("value is not null").select(*_KEY, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "left", "right")


def base_spans(found: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end of the valid matches of the four base patterns."""
    value, good = F.col("value"), F.lit(False)
    for kind in BASE:
        good = F.when(F.col("kind") == kind, _valid(kind, value)).otherwise(good)
    return found.where(F.col("kind") != "candidate").where(good).select(*_KEY, "kind", "start", "end")


def _seed_kind(value: Column) -> Column:
    """The kind that a whole candidate strictly is; null for others."""
    kind = F.when(value.rlike(SECRET), "secret")
    for name in ("email", "ip", "phone", "card"):
        pattern = BASE[name][0].replace(r"|\G", "")
        kind = kind.when(value.rlike(rf"\A(?:{pattern})\z"), F.when(_valid(name, value), name))
    return kind


#: How a value of a kind is written, at the least: no context makes an email of a number.
WRITTEN = {
    "email": r"[\p{L}\p{N}]@[\p{L}\p{N}]",
    "ip": r"\A[0-9]++(?:[.:][0-9]++){2,}+\z",
    "card": r"\A[0-9](?:[ -]?[0-9]){11,}+\z",
    "phone": r"\A[+(]?[0-9](?:[ ().+/-]*+[0-9]){6,}+\z",
    "secret": r"\A(?=[^0-9]*+[0-9])(?=\P{L}*+\p{L})[^\s]{16,}+\z",
}


def _bit(kind: Column) -> Column:
    found = F.lit(0)
    for n, name in enumerate(KINDS):
        found = F.when(kind == name, 1 << n).otherwise(found)
    return found


def candidates(found: DataFrame) -> DataFrame:
    """One row per candidate that can be an identifier: its place, instance, seed kind, whether a base pattern finds
    something in it, the kinds that it is written like (bits), and its lexical patterns (128-bit hashes)."""
    core = F.regexp_replace("value", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z", "")
    rows = found.where(F.col("kind") == "candidate").select(*_KEY, "start", "left", "right", core.alias("value"))
    value = F.col("value")
    rows = rows.where(value.rlike(r"[\p{L}\p{N}]@[\p{L}\p{N}]") | (_digits(value) >= LEAST_DIGITS))
    inside = F.lit(False)
    for kind in ("email", "ip"):
        inside |= value.rlike(BASE[kind][0])
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}++", "a"), r"[0-9]++", "9")
    before, both = F.substring_index("left", " ", -1), F.col("left")
    patterns = F.array(
        F.when(both.contains(" "), F.concat_ws("\0", F.lit("two before"), both)),
        F.when(before != "", F.concat_ws("\0", F.lit("before"), before)),
        F.when((before != "") & (F.coalesce("right", F.lit("")) != ""), F.concat_ws("\0", F.lit("around"), before, "right")),
        F.when(before != "", F.concat_ws("\0", F.lit("before a shape"), before, shape)),
    )
    fits = sum((F.when(value.rlike(pattern), 1 << KINDS.index(kind)).otherwise(0) for kind, pattern in WRITTEN.items()), F.lit(0))
    hashed = F.transform(F.array_compact(patterns), lambda p: F.unhex(F.md5(p.cast("binary"))))
    return rows.select(
        *_KEY, "start", (F.col("start") + F.length("value")).cast("int").alias("end"), _key(value).alias("instance"),
        _seed_kind(value).alias("seed"), inside.alias("inside"), fits.alias("fits"), hashed.alias("patterns"),
    )


def confident_patterns(rows: DataFrame, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """pattern, kind, score: scored over the pattern-instance graph, whose edges are counted before any join."""
    edges = rows.select(F.explode("patterns").alias("pattern"), "instance", "seed", "fits")
    edges = edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("fits").alias("fits"))
    edges = durable(edges)
    # Patterns with too few seeds can never be confident, in no round: they are only left in the totals.
    able = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    able = able.where(F.col("seeds") >= seeds).select("pattern", "kind")
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total")).join(able.select("pattern").distinct(), "pattern", "left_semi")
    able = durable(able.join(totals, "pattern"))
    open_edges = durable(edges.join(able.select("pattern").distinct(), "pattern", "left_semi"))
    known = open_edges.where("seed is not null").select("pattern", F.col("seed").alias("kind"), F.col("n").cast("double").alias("mass"))
    mass, last, patterns = known, None, None
    fits = F.col("fits").bitwiseAND(_bit(F.col("kind"))) != 0
    for _ in range(MAX_ROUNDS):
        scored = mass.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass")).join(able, ["pattern", "kind"])
        scored = scored.select("pattern", "kind", (F.col("mass") / F.col("total")).alias("score")).where(F.col("score") >= confidence)
        patterns = durable(scored)
        now = tuple(patterns.agg(F.count("*"), F.round(F.sum("score"), 6)).first())
        if now == last or not now[0]:
            return patterns
        last = now
        # An instance's score: 1 less the product of what its patterns leave open.
        held = open_edges.where("seed is null").join(patterns.withColumnRenamed("score", "s"), "pattern").where(fits)
        raised = held.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("s"), F.lit(1e-9)))))).alias("share"))
        more = open_edges.where("seed is null").join(raised, "instance").select("pattern", "kind", (F.col("n") * F.col("share")).alias("mass"))
        mass = known.unionByName(more)
    raise RuntimeError("the scores of patterns did not settle")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end of all spans; kinds of BASE for base spans, others for added ones."""
    found = durable(matches(texts_of(docs)))
    rows = durable(candidates(found))
    good = confident_patterns(rows)
    new = rows.where(F.col("seed").isNull() & ~F.col("inside")).select(*_KEY, "start", "end", "fits", F.explode("patterns").alias("pattern"))
    new = new.join(good, "pattern").where(F.col("fits").bitwiseAND(_bit(F.col("kind"))) != 0)
    new = new.groupBy(*_KEY, "start", "end").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    new = new.select(*_KEY, F.when(F.col("kind") == "secret", "secret").otherwise(F.concat(F.lit("found_"), "kind")).alias("kind"), "start", "end")
    secret = rows.where("seed = 'secret'").select(*_KEY, F.lit("secret").alias("kind"), "start", "end")
    return base_spans(found).unionByName(secret).unionByName(new)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) of every row of docs, base ones by kind as listed, then start."""
    rank = F.lit(len(BASE))
    for n, kind in enumerate(BASE):
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    listed = spans(docs).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("s"))
    part = lambda base: F.transform(F.filter("s", lambda x: (x["rank"] < len(BASE)) == F.lit(base)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    listed = durable(listed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), part(True).alias("base"), part(False).alias("added")))
    rows = texts_of(docs).select("doc_id", _key(F.col("text")).alias("text_key"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans."""

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select("doc_id", *map(of, BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


def _cuts(found: DataFrame) -> DataFrame:
    """For each text with spans: number of a chunk to what is cut from it (from, to, end of the cut before, tag).

    Overlapping spans become one, with the kind of the one that starts first.
    """
    order = Window.partitionBy(*_KEY).orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.distinct().withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    joined = fresh.withColumn("g", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(*_KEY, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", F.negative("end"), "kind"))["kind"].alias("kind"))
    first, last = F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int")
    dealt = whole.withColumn("first", first).withColumn("c", F.explode(F.sequence("first", last)))
    tag = F.when(F.col("c") == F.col("first"), F.concat(F.lit("<"), F.upper(F.regexp_replace("kind", r"\Afound_", "")), F.lit(">"))).otherwise("")
    dealt = dealt.select(*_KEY, "c", F.greatest(F.col("start") - F.col("c") * CHUNK, F.lit(0)).alias("a"), F.least(F.col("end") - F.col("c") * CHUNK, F.lit(CHUNK)).alias("b"), tag.alias("tag"))
    before = F.coalesce(F.lag("b").over(Window.partitionBy(*_KEY, "c").orderBy("a")), F.lit(0))
    dealt = dealt.withColumn("past", before).groupBy(*_KEY, "c").agg(F.array_sort(F.collect_list(F.struct("a", "b", "past", "tag"))).alias("cut"))
    return dealt.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("c", "cut"))).alias("cuts"))


def redact(docs: DataFrame) -> DataFrame:
    """All columns, with every span in ``text`` replaced by its kind in angle brackets; overlaps become one.

    A text with spans is cut into pieces, so that the work on a long one grows with its length only.
    """
    cuts = durable(_cuts(spans(docs)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cuts = cuts.withColumn("_h", F.xxhash64("_id", "_key"))
    rows, others = part_listed(rows, F.xxhash64("row.doc_id", _key(F.col("row.text"))), cuts)
    rows = rows.join(cuts, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (_key(F.col("row.text")) == F.col("_key")), "left")

    def clean(piece: Column, cut: Column) -> Column:
        kept = F.transform(cut, lambda s: F.concat(F.substring(piece, s["past"] + 1, s["a"] - s["past"]), s["tag"]))
        return F.concat(F.array_join(kept, ""), F.substring(piece, F.element_at(cut, -1)["b"] + 1, F.lit(CHUNK)))

    pieces = F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    changed = F.transform(pieces, lambda p, i: F.when(F.map_contains_key("cuts", i), clean(p, F.element_at("cuts", i))).otherwise(p))
    text = F.when(F.col("cuts").isNotNull(), F.array_join(changed, "")).otherwise(F.col("row.text"))
    return others.select("row.*").unionByName(rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
