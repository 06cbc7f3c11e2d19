"""Personal data: spans of known forms, and terms that reveal them.

Emails, IP addresses, card and phone numbers are found by patterns and checks; they are the protected entities. Over
the distinct texts of the corpus it is counted in how many each term stands, in how many of these with an entity, and
so how much of the entity's information content the term discloses:

    disclosure(t, e) = PMI(t, e) / IC(e) = log(p(e | t) / p(e)) / -log p(e)

p(e | t) is drawn towards p(e) by ``prior`` texts, so that few texts are weak evidence of a common entity. Terms are
held against two kinds of entities:

* each value, with the terms up to ``window`` words from it; a value that occurs once is enough;
* over whole texts, each value of ``min_contexts`` texts at least, and the rarer values of one kind pooled as one
  entity. Here a term counts that stands between different words ``min_contexts`` times at least in such texts, so that
  near copies of one text flag nothing.

A term that discloses ``threshold`` of some entity or more is a span wherever it occurs, and is generalised or removed
with the others.

A secret (a key, a token) is a protected entity too, but has no form of its own. It is known by its information: a run
of ``secret_length`` letters and digits or more, of both, with ``secret_bits`` of entropy or more in each character. It
reveals itself wholly, so every one is a span (kind ``secret``), also if it is seen once.

Only DataFrame functions are used. Null text is empty; an empty table gives no rows. Repeated rows get equal results.
Long texts are read whole, and a span costs about the same at any place. Columns named ``pii_<kind>`` are replaced;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded, free, materialise

# The patterns match the same text as their plain forms do, without backtracking into a run of characters:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]"
KINDS = (*PATTERNS, "secret", "term")
#: A text without this can't hold the kind.
_HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
_BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    threshold: float = 0.9
    #: Different contexts (two words on either side) of a term in texts with an entity, over whole texts; values of fewer texts are pooled.
    min_contexts: int = 3
    #: Words on either side of a value that count as near it.
    window: int = 10
    #: Texts that p(e | t) is drawn towards p(e) by.
    prior: float = 0.5
    #: Characters of a secret at least, and bits of entropy of each.
    secret_length: int = 20
    secret_bits: float = 3.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body holds lambdas."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _located(text: Column, pattern: str | Column, kind: str, matches: Column) -> Column:
    """The matches as spans in code points. Running lengths are summed by blocks, so that many matches cost little more than each one."""

    def spans(m: Column, g: Column, steps: Column, before_block: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            at = before_block[block] + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + F.length(g[i])
            return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x)).alias("end"), x.alias("value"), g[i].alias("before"), g[i + 1].alias("after"))

        return F.transform(m, span)

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))

    def sums(per_block: Column) -> Column:
        return F.transform(per_block, lambda _, b: _sum(F.slice(per_block, F.lit(1), b)))

    def found(m: Column) -> Column:
        return _let(
            F.split(text, pattern, -1),
            lambda g: _let(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b)), lambda steps: _let(blocks(steps), lambda per: _let(sums(per), lambda done: spans(m, g, steps, done)))),
        )

    return _let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(found(m)))


def _valid(kind: str) -> Callable[[Column], Column]:
    def part(p: Column) -> Column:
        n = F.regexp_replace(p, "^0+", "")
        return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

    def digits(s: Column) -> Column:
        return F.regexp_replace(s["value"], "[^0-9]", "")

    return {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), part),
        "card": lambda s: _let(digits(s), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)),
        "phone": lambda s: F.length(digits(s)).between(8, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: the spans of a text, leftmost first, that pass the kind's check."""
    return {k: F.filter(_located(text, p, k, F.when(_HINTS[k](text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))), _valid(k)) for k, p in PATTERNS.items()}


def _entropy(value: Column) -> Column:
    """Bits of a character of the value, by its own frequencies."""
    n = F.length(value)
    times = F.transform(F.array_distinct(F.split(value, "")), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    return F.aggregate(times, F.lit(0.0), lambda a, k: F.when(k > 0, a - k / n * F.log2(k / n)).otherwise(a))


def secret_spans(text: Column, how: Disclosure) -> Column:
    """Runs of letters and digits that hold as much information as only keys do."""
    run = rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{how.secret_length},}}+"
    found = F.when(text.rlike(rf"[A-Za-z0-9_-]{{{how.secret_length}}}"), F.regexp_extract_all(text, F.lit(run), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(_located(text, run, "secret", found), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (_entropy(s["value"]) >= how.secret_bits))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return _let(others, lambda o: F.filter(spans, lambda s: ~F.exists(o, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))


def _terms(text: Column) -> Column:
    """The words with a letter outside of emails, lower-case."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(plain), F.lit(r"\p{N}*+\p{L}[\p{L}\p{N}]*+"), F.lit(0))


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _disclosure(n_term: str, n: int, prior: float) -> Column:
    """PMI over information content, from the counts of n texts."""
    p = F.col("n_entity") / F.lit(float(n))
    return 1 - F.log((F.least("n_both", n_term) + prior * p) / (F.col(n_term) + prior)) / F.log(p)


def revealing_terms(docs: DataFrame, how: Disclosure, text_column: str) -> tuple[DataFrame, DataFrame] | None:
    """(term, disclosure) of the terms over the threshold, and (key, term) of the texts that hold them; None if there are none."""
    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    n = texts.select("key").distinct().count()
    # the last words before a value and the first ones after it
    near = F.transform("s", lambda s: F.struct(
        s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["value"]).alias("value"),
        F.concat(_let(_terms(s["before"]), lambda w: F.slice(w, F.greatest(F.size(w) - how.window + 1, F.lit(1)), F.lit(how.window))), F.slice(_terms(s["after"]), F.lit(1), F.lit(how.window))).alias("words"),
    ))
    held = texts.where(F.col("text").rlike("[0-9]|@")).withColumn("s", F.concat(*base_spans(F.col("text")).values(), secret_spans(F.col("text"), how))).where("size(s) > 0")
    held = materialise(held.select("key", near.alias("near"), _terms(F.col("text")).alias("words")), "entities")
    spots = held.select("key", F.explode("near").alias("x"))

    values = spots.select("key", "x.kind", "x.value").distinct()
    counts = values.groupBy("value").agg(F.count("*").alias("n_entity"))
    named = materialise(values.join(counts, "value").select("key", "value", "n_entity", F.when(F.col("n_entity") < how.min_contexts, F.col("kind")).otherwise(F.col("value")).alias("entity")), "values")
    beside = spots.select("key", "x.value", F.explode("x.words").alias("term")).distinct().groupBy("value", "term").agg(F.count("*").alias("n_both"))
    beside = beside.join(counts, "value").select("term", "n_both", "n_entity")

    # over whole texts; a term occurs in as many texts at least as with any entity in, which bounds what it can disclose
    present = materialise(held.select("key", F.explode(F.array_distinct("words")).alias("term")).distinct(), "present")
    anywhere = present.groupBy("term").agg(F.count("*").alias("n_near"))
    pools = named.select("key", "entity").distinct()
    pool_counts = pools.groupBy("entity").agg(F.count("*").alias("n_entity"))
    enough = (F.col("n_entity") < n) & (_disclosure("n_near", n, how.prior) >= how.threshold)
    whole = present.join(pools, "key").groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(pool_counts, "entity").join(anywhere, "term").where(enough)
    whole = materialise(whole.select("entity", "term", "n_both", "n_entity"), "whole")

    # the contexts of what is left; they are hashed, so that no two rows of one text and context meet
    def context(w: Column, i: Column) -> Column:
        return F.struct(w.alias("term"), F.xxhash64(*(F.coalesce(F.get("words", i + d), F.lit("")) for d in (-2, -1, 1, 2))).alias("context"))

    terms = bounded(whole.select("term").distinct())
    own = materialise(present.join(terms, "term"), "own")
    near_texts = held.join(bounded(own.select("key").distinct()), "key", "left_semi")
    used = near_texts.select("key", F.explode(F.transform("words", context)).alias("x")).select("key", "x.term", "x.context").join(terms, "term").distinct()
    often = used.join(pools, "key").select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= how.min_contexts)
    whole = whole.join(often, ["entity", "term"]).select("term", "n_both", "n_entity")

    candidates = materialise(beside.join(anywhere, "term").where(enough).select("term", "n_both", "n_entity").union(whole).distinct(), "candidates")
    free(own)
    if candidates.isEmpty():
        return None
    words = texts.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    mentions = materialise(words.join(bounded(candidates.select("term").distinct()), "term").select("key", "term").distinct(), "mentions")
    known = candidates.join(mentions.groupBy("term").agg(F.count("*").alias("n_term")), "term")
    known = known.withColumn("disclosure", _disclosure("n_term", n, how.prior))
    flagged = materialise(known.where(F.col("disclosure") >= how.threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")
    free(held, named, present, candidates)
    return None if flagged.isEmpty() else (flagged, mentions.join(bounded(flagged.select("term")), "term"))


def find_personal_data(docs: DataFrame, how: Disclosure | None = None, *, text_column: str = "text") -> DataFrame:
    """``docs`` with ``pii_<kind>`` for each of KINDS: arrays of spans (kind, start, end, value, before, after)."""
    how = how or Disclosure()
    text = F.coalesce(F.col(text_column), F.lit(""))
    terms = revealing_terms(docs, how, text_column)
    out = docs.drop(*(f"pii_{k}" for k in KINDS)).withColumns({f"pii_{k}": c for k, c in base_spans(text).items()})
    base = F.concat(*(F.col(f"pii_{k}") for k in PATTERNS))
    out = out.withColumn("pii_secret", _apart(secret_spans(text, how), base))
    if terms is None:
        return out.withColumn("pii_term", F.array().cast(_SPAN))
    held = materialise(terms[1].groupBy("key").agg(F.collect_set("term").alias("pii_held")), "held").withColumnRenamed("key", "pii_key")
    out = out.withColumn("pii_key", F.xxhash64(text)).join(bounded(held), "pii_key", "left").drop("pii_key")
    # terms are letters and digits only, so that they stand for themselves in a pattern
    any_of = F.concat(F.lit(rf"(?iu)(?<!{WORD})(?:"), F.array_join(F.array_sort("pii_held"), "|"), F.lit(rf")(?!{WORD})"))
    spots = _located(text, any_of, "term", F.regexp_extract_all(text, any_of, F.lit(0)))
    own = _apart(spots, F.concat(base, F.col("pii_secret")))
    return out.withColumn("pii_term", F.when(F.col("pii_held").isNull(), F.array().cast(_SPAN)).otherwise(own)).drop("pii_held")


def redact(found: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The result of ``find_personal_data`` with every span generalised to its kind, like [EMAIL], and revealing terms removed; null text stays null."""
    spans = F.array_sort(F.concat(*(F.transform(f"pii_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in KINDS)))
    text = F.col(text_column)

    def put(state: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        free = s["start"] >= state["at"]
        return F.struct(
            F.when(free, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), label)).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans, start, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    some = sum((F.size(f"pii_{k}") for k in KINDS), F.lit(0)) > 0
    return found.withColumn(text_column, F.when(some & text.isNotNull(), whole).otherwise(text)).drop(*(f"pii_{k}" for k in KINDS))


def span_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, counts by kind and of all spans, the SHA-256 of the base spans, and all spans written as kind:start:end."""
    base = F.concat(*(F.col(f"pii_{k}") for k in PATTERNS))
    return found.select(
        id_column,
        *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat(base, F.col("pii_secret"), F.col("pii_term"))).alias("spans"),
        F.size("pii_secret").cast("long").alias("n_secret"),
        F.size("pii_term").cast("long").alias("n_term"),
        sum((F.size(f"pii_{k}").cast("long") for k in KINDS), F.lit(0)).alias("n_spans"),
    )
