"""Personal data by patterns, and the terms that give it away, in DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers.  Then terms that
disclose a protected entity are added.  Protected are the value of each base span, its class (domain of an
address, first half of an IP, issuer of a card, prefix of a phone number) and secret values: what a text
assigns to a token, a password or a key.  Over the whole corpus, the co-occurrence of an entity with the
terms of its documents estimates how much a term tells about it,

    disclosure = ln(p(entity | term) * N / n_e) / ln(N / n_e),   p(entity | term) = (n_et - DISCOUNT) / n_t,

which is PMI(term; entity) over IC(entity) with a discounted estimate, so that few documents prove little.
The counts are of distinct texts (copies are no evidence): n_et with both, n_e, n_t, and N in all.  The terms of
a secret value need no estimate of what they name, so nothing is discounted for them: at 1 a term stands only
where the secret does.  Terms from ``DISCLOSURE`` on are generalised, those from ``REMOVE`` on are removed,
wherever they stand outside base spans, in documents without the entity too.

A term that stands in only one of the texts with an entity is no co-occurrence, and entities of one text have no
such term; both are left out.  Entities of exactly the same texts count once.

A null text counts as empty.  Repeated rows get the same spans.  Extra columns play no part.  An empty table gives
an empty one.  Long texts full of numbers take time in proportion to n ** 1.5 at most for n matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, text_or_empty

#: Kinds in the order in which spans at the same place are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, written so that matching is linear and needs no recursion in the JVM's regex engine: a
#: run of repeated groups is one lazy class up to where the run must end, and a match starts where a run does.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?"
    r"(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A card has 14 digits at least: runs are maximal, so a match that a shorter run would fail is never tried.
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){13})[0-9][\x20-]?[0-9][0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?(?:[^0-9\x20-]|\z))",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINT = {"email": "@", "phone": "+"}
_HINT_PATTERN = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}"}
#: A term is letters and digits, with single apostrophes and hyphens inside; this is what lies between terms.
NOT_TERM = r"[^\p{L}\p{N}'-]+|(?<![\p{L}\p{N}])['-]+|['-]+(?![\p{L}\p{N}])"
BEFORE_TERM = r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}]['-])"
BEHIND_TERM = r"(?![\p{L}\p{N}]|['-][\p{L}\p{N}])"
#: A secret is what is assigned to such a name.
SECRET = (
    r"(?i)(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private)[_-]?key)[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?"
    r"([^\s\x22',;]{8,})"
)

#: Least length of a term, and of a term of a secret value.
MIN_TERM = 3
MIN_SECRET = 8
#: Texts that both a term and an entity must stand in.
MIN_TEXTS = 2
#: What the estimate takes off the count of texts with both.
DISCOUNT = 0.75
DISCLOSURE = 0.9
REMOVE = 0.999
#: Rows and bytes (written as JSON) of tables of entities, terms and treated documents that are broadcast at most,
#: after both are counted; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 1 << 26
#: Elements of one block of a running sum.
BLOCK = 256
#: Placeholders of the sanitised text.
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    added = F.transform(
        F.filter(each, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(added, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = _digits(value)
    n = F.length(digits)
    return F.when(n.between(14, 19), _luhn(digits)).otherwise(False) if kind == "card" else n.between(10, 15)


def _let(c: Column, then) -> Column:
    """``then(c)``, where ``c`` is computed once."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array in blocks of ``BLOCK`` elements; it must not be empty."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int"))
    return F.transform(starts, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, op) -> Column:
    """What ``op`` makes of the elements (not negative) up to and with each one; 0 is its neutral value.

    Inside blocks first, then over the blocks: appending to one long array would take time with its square.
    """
    none = F.array().cast("array<int>")

    def scan(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))

    def join(inner: Column) -> Column:
        ends = scan(F.transform(inner, lambda b: F.element_at(b, -1)))
        return _let(
            ends,
            lambda e: F.flatten(
                F.transform(inner, lambda b, i: _let(F.coalesce(F.get(e, i - 1), F.lit(0)), lambda at: F.transform(b, lambda x: op(at, x))))
            ),
        )

    blocks = lambda v: _let(F.transform(_blocks(v), scan), join)
    return _let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(none))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    Lengths of the pieces between the matches and of the matches give the places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(found: Column) -> Column:
        lengths = F.transform(found, lambda v: F.length(v))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.length(g))
        ends = running(F.zip_with(gaps, lengths, lambda g, n: g + n), lambda a, b: a + b)
        return F.zip_with(
            ends, found, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return _let(values, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(none))


def _mentions_of(kind: str, text: Column) -> Column:
    """The valid matches of one kind, where the text has what the pattern needs."""
    k = KINDS.index(kind)
    hint = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike(_HINT_PATTERN[kind])
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(
        good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    )
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def base_mentions(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the base spans, by start and then kind."""
    return F.sort_array(F.concat(*[_mentions_of(kind, text) for kind in KINDS[:4]]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _entities(base: Column, secrets: Column) -> Column:
    """What is protected in a document: values, their classes, and secret values."""

    def of(m: Column) -> Column:
        digits = _digits(m["value"])
        value = F.when(m["kind"] == 0, F.lower(m["value"])).when(m["kind"] == 1, m["value"]).otherwise(digits)
        whole = F.substring_index(F.lower(m["value"]), "@", -1)
        kind = (
            F.when(m["kind"] == 0, whole).when(m["kind"] == 1, F.substring_index(m["value"], ".", 2)).otherwise(F.substring(digits, 1, 6))
        )
        return F.array(F.concat_ws(":", m["kind"], value), F.concat_ws(":", F.lit("class"), m["kind"], kind))

    named = F.transform(secrets, lambda v: F.concat(F.lit("secret:"), v))
    return F.array_distinct(F.concat(F.flatten(F.transform(base, of)), named))


def _forms(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_distinct(F.split(text, NOT_TERM))


def _terms(text: Column) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(_forms(text), F.lower))


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is known to be small; Spark splits the hot keys of other joins."""
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(table) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else table


def _key(id_col: str, text: Column) -> list[Column]:
    """Columns that tell documents apart, never null."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64(text).alias("k_text")]


def find_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_text, doc_id, base (mentions), secrets and, where there are any, the document's terms outside the mentions; written out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    secrets = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(SECRET), F.lit(1)))
    rows = rows.withColumns({"base": base_mentions(F.col("text")), "secrets": secrets})
    named = F.flatten(F.transform("base", lambda m: _terms(m["value"])))
    terms = F.when((F.size("base") > 0) | (F.size("secrets") > 0), F.array_except(_terms(F.col("text")), named))
    return materialise(rows.select(*_key("doc_id", F.col("text")), "doc_id", "base", "secrets", terms.alias("terms")), "mentions")


def _disclosure(n: int, n_et: Column, n_e: Column, n_t: Column, own: Column) -> Column:
    p = (n_et - F.when(own, 0.0).otherwise(DISCOUNT)) / n_t
    return 1 + F.log(p) / F.log(F.lit(float(n)) / n_e)


def candidate_terms(mentions: DataFrame, least: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(entity, term, own, n_e, n_et) of the pairs that may reach the threshold: with n_t as low as what the texts
    with entities alone have of the term.  Written out."""
    n = mentions.select("k_text").distinct().count()
    held = mentions.where("terms IS NOT NULL").dropDuplicates(["k_text"])
    held = held.select("k_text", "terms", "secrets", _entities(F.col("base"), F.col("secrets")).alias("entities"))
    held = materialise(held, "held")
    named = held.select("k_text", F.explode("entities").alias("entity"))
    # Entities of exactly the same texts have the same counts: the least one stands for all.
    marks = [F.bit_xor("k_text").alias("s"), F.bit_xor(F.xxhash64("k_text", F.lit(1))).alias("s2")]
    often = named.groupBy("entity").agg(F.count("*").alias("n_e"), *marks).where((F.col("n_e") >= min_texts) & (F.col("n_e") < n))
    often = materialise(often.groupBy("n_e", "s", "s2").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "entities")
    words = held.select("k_text", F.explode("terms").alias("term")).where((F.length("term") >= MIN_TERM) & F.col("term").rlike(r"\p{L}"))
    seen = words.groupBy("term").agg(F.count("*").alias("n_held")).where(F.col("n_held") >= min_texts)  # others have no pair
    few = words.join(seen, "term").groupBy("k_text").agg(F.collect_list(F.struct("term", "n_held")).alias("words"))
    pairs = named.join(_few(often), "entity").join(few, "k_text").select("entity", "n_e", F.explode("words").alias("w"))
    pairs = pairs.groupBy("entity", "n_e", "w.term", "w.n_held").agg(F.count("*").alias("n_et"))
    pairs = pairs.where((F.col("n_et") >= min_texts)).withColumn("own", F.lit(False))
    pairs = pairs.where(_disclosure(n, F.col("n_et"), F.col("n_e"), F.col("n_held"), F.col("own")) >= least)
    secret = held.select("k_text", F.explode("secrets").alias("value")).groupBy("value").agg(F.count("*").alias("n_e"))
    secret = secret.select(F.concat(F.lit("secret:"), "value").alias("entity"), "n_e", F.explode(_terms(F.col("value"))).alias("term"))
    secret = secret.where((F.length("term") >= MIN_SECRET) & (F.col("n_e") < n))
    own = secret.select("entity", "term", F.lit(True).alias("own"), "n_e", F.col("n_e").alias("n_et"))
    return materialise(pairs.select("entity", "term", "own", "n_e", "n_et").unionByName(own), "candidates")


def places(docs: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """(k_id, k_text, form, term) of every document and candidate term that it holds, as it is written; written out."""
    text = text_or_empty(text_col)
    words = docs.select(*_key("doc_id", text), F.explode(_forms(text)).alias("form")).where(F.length("form") >= MIN_TERM)
    terms = materialise(candidates.select("term").distinct(), "terms")
    return materialise(words.withColumn("term", F.lower("form")).join(_few(terms), "term").distinct(), "places")


def disclosing_terms(mentions: DataFrame, candidates: DataFrame, found: DataFrame, least: float = DISCLOSURE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold; ``found`` are the ``places`` of all candidates."""
    n = mentions.select("k_text").distinct().count()
    n_t = found.select("term", "k_text").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    told = _disclosure(n, F.col("n_et"), F.col("n_e"), F.col("n_t"), F.col("own"))
    return candidates.join(n_t, "term").withColumn("disclosure", told).where(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def term_forms(docs: DataFrame, mentions: DataFrame, least: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """k_id, k_text and ``forms``: array<struct<form, disclosure>> of the disclosing terms a document holds; written out."""
    candidates = candidate_terms(mentions, least, min_texts)
    found = places(docs, candidates)
    terms = disclosing_terms(mentions, candidates, found, least).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    hits = found.join(_few(materialise(terms, "disclosing")), "term")
    forms = F.sort_array(F.collect_set(F.struct("form", "disclosure"))).alias("forms")
    return materialise(hits.groupBy("k_id", "k_text").agg(forms), "forms")


def added_spans(text: Column, forms: Column, base: Column) -> Column:
    """array<struct<start, end, disclosure>>: every place of ``forms`` in ``text`` that overlaps no base span."""
    any_form = F.array_join(F.transform(forms, lambda f: f["form"]), "|")
    pattern = F.concat(F.lit(f"{BEFORE_TERM}(?:"), any_form, F.lit(f"){BEHIND_TERM}"))
    rank = _let(
        F.map_from_entries(forms),
        lambda of: F.transform(
            matches(text, pattern),
            lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("added"), t["end"].alias("end"), F.element_at(of, t["value"]).alias("disclosure")),
        ),
    )
    own = F.transform(
        base,
        lambda m: F.struct(m["start"].alias("start"), F.lit(0).alias("added"), m["end"].alias("end"), F.lit(None).cast("double").alias("disclosure")),
    )
    far = 2**31 - 1

    def free(spans: Column) -> Column:
        """Those that no base span before reaches and none behind begins in."""
        reached = running(F.transform(spans, lambda s: F.when(s["added"] == 0, s["end"]).otherwise(0)), F.greatest)
        behind = F.transform(F.reverse(spans), lambda s: F.when(s["added"] == 0, F.lit(far) - s["start"]).otherwise(0))
        begun = F.reverse(running(behind, F.greatest))
        edges = F.zip_with(reached, begun, lambda r, b: F.struct(r.alias("reached"), (F.lit(far) - b).alias("begun")))
        both = F.filter(
            F.zip_with(spans, edges, lambda s, e: F.struct(s.alias("s"), e.alias("e"))),
            lambda x: (x["s"]["added"] == 1) & (x["e"]["reached"] <= x["s"]["start"]) & (x["e"]["begun"] >= x["s"]["end"]),
        )
        return F.transform(
            both, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["disclosure"].alias("disclosure"))
        )

    return _let(F.sort_array(F.concat(own, rank)), free)


def _bare(base: Column) -> Column:
    return F.transform(base, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (array<struct<start, kind, end>>), and added."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mentions = find_mentions(rows)
    text = text_or_empty()
    keyed = rows.select(*_key("doc_id", text), text.alias("text"))
    held = keyed.join(_few(term_forms(rows, mentions, **limits)), ["k_id", "k_text"]).dropDuplicates(["k_id", "k_text"])
    held = held.withColumn("base", base_mentions(F.col("text")))
    added = held.select("k_id", "k_text", added_spans(F.col("text"), F.col("forms"), F.col("base")).alias("added"))
    terms = F.transform("added", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    joined = mentions.join(added, ["k_id", "k_text"], "left").withColumn("base", _bare(F.col("base")))
    spans = F.sort_array(F.concat("base", F.coalesce(terms, F.array().cast(_SPAN))))
    return joined.select("doc_id", "base", spans.alias("spans"), "added")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (array<struct<start, end, by>>, by start) replaced; overlapping ones become one,
    with the placeholder of the first.  The text is cut in two steps, blocks of spans and spans, since a cut takes
    time with its place."""

    def cut(heads: Column) -> Column:
        def block(b: Column) -> Column:
            first = F.element_at(b, 1)["from"]
            part = F.substring(text, first + 1, F.element_at(b, -1)["start"] - first)
            return _let(
                part,
                lambda p: F.array_join(
                    F.transform(b, lambda h: F.concat(F.substring(p, h["from"] - first + 1, h["start"] - h["from"]), h["by"])), ""
                ),
            )

        return F.array_join(F.transform(_blocks(heads), block), "")

    def whole(reached: Column) -> Column:
        """``reached``: the greatest end up to each span; a span that begins there or later is a head."""
        before = F.transform(spans, lambda s, i: F.coalesce(F.get(reached, i - 1), F.lit(0)))
        heads = F.filter(
            F.zip_with(spans, before, lambda s, r: F.struct(r.alias("from"), s["start"].alias("start"), s["by"].alias("by"))),
            lambda h: h["start"] >= h["from"],
        )
        tail = F.substring(text, F.element_at(reached, -1) + 1, F.length(text))
        return F.concat(_let(heads, cut), tail)

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, _let(ends, whole)).otherwise(text)


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with base spans replaced by placeholders, disclosing terms generalised or removed, and
    ``n_chars`` (where there is one) brought up to date."""
    mentions = find_mentions(docs)
    keys = ["k_id", "k_text"]
    treated = mentions.where(F.size("base") > 0).select(*keys, "base").dropDuplicates(keys)
    treated = treated.join(term_forms(docs, mentions, **limits), keys, "full")
    treated = _few(materialise(treated.withColumnsRenamed({c: f"__{c}" for c in (*keys, "base", "forms")}), "treated"))
    text = text_or_empty()
    rows = docs.withColumns(dict(zip(("__k_id", "__k_text"), _key("doc_id", text)))).join(treated, ["__k_id", "__k_text"], "left")
    none = F.array().cast("array<struct<start:int,end:int,by:string>>")
    names = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS])
    base = F.coalesce("__base", F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    added = F.transform(
        added_spans(text, F.col("__forms"), base),
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"),
            F.when(t["disclosure"] >= REMOVE, "").otherwise(PLACEHOLDERS["term"]).alias("by"),
        ),
    )
    by = F.transform(base, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.get(names, m["kind"]).alias("by")))
    spans = F.sort_array(F.concat(by, F.when(F.col("__forms").isNotNull(), added).otherwise(none)))
    rows = rows.withColumn("__spans", spans).withColumn("__clean", _let(F.col("__spans"), lambda s: replaced(text, s)))
    some = F.size("__spans") > 0
    rows = rows.withColumn("text", F.when(some, F.col("__clean")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
