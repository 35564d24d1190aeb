"""Personal data: candidate spans, boosted trees, calibrated thresholds
(DataFrame functions and Spark's own GBTClassifier only).

The base detectors find validated emails, IP addresses, card and phone numbers.
Beside them, high-recall generators propose overlapping spans: obfuscated
emails, spaced addresses, digit runs with separators. Every proposal is
described by its format (separators, groups, checksum) and its context (the
characters and words around it), without the + and @ of the base rules.

Boosted trees, one set a kind, learn from all base spans, written
as the base rules do not find them (name [at] host [dot] org, 10 . 0 . 0 . 1,
phone numbers without +, cards with other separators), each in its own context.
Against them stand counterfeits in the same contexts (words around an @, wrong
checksums, octets above 255, enumerations, bare numbers, dates) and proposals
that cannot be valid. Proposals that overlap no base span and may be valid are
what the trees decide on, so they are in neither class. Per kind the threshold
is set so that of the negatives kept out of the fit almost none pass it; a kind
is used if at least half of the positives kept out pass. Proposals above the
threshold that overlap no base span are added; base spans always stay.

Positions come from one pass: the pieces between the matches (split) and the
matches (extract) have known lengths, so starts are their running sums.

Defined cases: null or empty text has no spans; a kind without base spans, in
the fit or kept out, has nothing to learn from -> only base spans; equal rows get equal spans; an empty table gives no
rows; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import materialize, other_columns_aside

KINDS = ("email", "ip", "card", "phone")

# Base patterns. The run before an @ and a run of digits are matched from their
# start (or from the end of the previous match) and possessively, which finds
# the same spans without backtracking over long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators.
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\.\x20?[0-9]{1,3}+){3}(?![0-9])",
    "number": r"(?<![0-9])[+(]{0,2}+[0-9](?:[\x20()./-]{0,3}+[0-9]){6,24}+(?![0-9])",
}
CONTEXT = ("mail", "ip", "host", "server", "card", "visa", "pay", "tel", "phone", "call", "fax")
# How a disguised span is written: an email's (at, dot), an address's dots, the separator of a card's or phone's groups.
AT_DOT = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", " . "), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."))
DOTS = (" . ", ". ", " .")
CARD_SEPARATORS = (".", "/", " - ", "--", " . ")
PHONE_SEPARATORS = (".", "-", " ", "/")
BLOCK = 32   # matches whose positions are summed up in one go
REACH = 64   # characters of a text's stretch in which spans are compared
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_to_number(
        F.substr(digits, n - i + 1, F.lit(1)), F.lit("9")).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.coalesce((n > 0) & (total % 10 == 0), F.lit(False))


def octets(s: Column) -> Column:
    """Whether all dot-separated numbers are at most 255."""
    def small(part: Column) -> Column:
        n = F.ltrim(part, F.lit("0"))
        return (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(F.replace(s, F.lit(" "), F.lit("")), r"\."), small)


def _valid(kind: str, s: Column) -> Column:
    d = _digits(s)
    return {"email": F.lit(True), "ip": octets(s), "card": F.length(d).between(16, 19) & luhn(d),
            "phone": F.length(d).between(8, 15)}[kind]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(matches: Column, gaps: Column) -> Column:
    """Every match m with the piece before it (g) and after it (n), in blocks of
    ``BLOCK``: an array that grows by appending is copied for each element, so
    running sums are taken within blocks and over blocks."""
    zipped = F.transform(matches, lambda m, i: F.struct(
        m.alias("m"), F.get(gaps, i).alias("g"), F.get(gaps, i + 1).alias("n")))
    last = F.floor((F.size(matches) - 1) / BLOCK).cast("int")
    return _let(zipped, lambda all_: F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))


def _block_starts(blocks: Column) -> Column:
    """Where every block of ``_steps`` starts in its text, one more at the end."""
    length = lambda block: F.aggregate(block, F.lit(0), lambda a, z: a + F.length(z["g"]) + F.length(z["m"]))
    return F.aggregate(F.transform(blocks, length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def _spans(blocks: Column, starts: Column) -> Column:
    """start, end (code points), s, before and after of every match."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,s:string,before:string,after:string>>)")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["g"])
        end = start + F.length(z["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), z["m"].alias("s"),
            F.lower(F.substring(z["g"], -24, 24)).alias("before"), F.substring(z["n"], 1, 2).alias("after")))).alias("out"))

    return _let(starts, lambda begun: F.flatten(F.transform(blocks, lambda block, i: F.aggregate(
        block, F.struct(F.get(begun, i).alias("at"), empty.alias("out")), step, lambda a: a["out"]))))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__base`` (spans) and ``__seen`` (proposals with text and
    context). Texts without a digit or an @ are passed over."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    mail = F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")
    when = {"email": mail, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit, "number": digit}
    none = F.expr("cast(array() as array<string>)")
    patterns = {**{f"b_{k}": (k, p) for k, p in BASE.items()}, **{f"p_{k}": (k, p) for k, p in PROPOSE.items()}}
    out = docs
    for name, (kind, pattern) in patterns.items():
        out = (out.withColumn(f"__m_{name}", F.when(when[kind], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
               .withColumn(f"__g_{name}", F.when(F.size(f"__m_{name}") > 0, F.split(text, pattern)).otherwise(none)))
    no_steps = F.expr("cast(array() as array<array<struct<m:string,g:string,n:string>>>)")
    for n in patterns:
        out = out.withColumn(f"__t_{n}", F.when(F.size(f"__m_{n}") > 0, _steps(F.col(f"__m_{n}"), F.col(f"__g_{n}"))).otherwise(no_steps))
    for n in patterns:
        out = out.withColumn(f"__s_{n}", _block_starts(F.col(f"__t_{n}")))
    for n in patterns:
        out = out.withColumn(f"__l_{n}", _spans(F.col(f"__t_{n}"), F.col(f"__s_{n}")))
    located = {n: F.col(f"__l_{n}") for n in patterns}

    def valid(kind: str) -> Column:
        return F.transform(F.filter(located[f"b_{kind}"], lambda x: _valid(kind, x["s"])), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*[valid(k) for k in KINDS])

    def proposal(name: str) -> Column:
        def one(x: Column) -> Column:
            kind = F.lit(name) if name != "number" else F.when(F.length(_digits(x["s"])) >= 13, "card").otherwise("phone")
            return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
                            x["before"].alias("before"), x["after"].alias("after"))
        return F.transform(located[f"p_{name}"], one)

    seen = F.concat(*[proposal(n) for n in PROPOSE])
    return out.withColumn("__base", base.cast(SPAN)).withColumn("__seen", seen).drop(
        *[f"__{a}_{n}" for n in patterns for a in "mgtsl"])


def _compared(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Proposals with ``label`` (1: equal to a base span of their text) and
    ``free`` (overlaps none). Spans meet where they touch the same ``REACH``
    characters of a text, so a text with many spans costs no more a span."""
    stretch = F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor((F.col("end") - 1) / REACH))).alias("at")
    b = base.distinct().select(F.col("__key").alias("k"), stretch, F.col("kind").alias("b_kind"),
                               F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    p = rows.select("__key", "kind", "start", "end").distinct().select("__key", "kind", "start", "end", stretch)
    same = (F.col("kind") == F.col("b_kind")) & (F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))
    met = (p.join(b, (F.col("__key") == F.col("k")) & (p["at"] == b["at"]) & (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start")))
           .groupBy("__key", "kind", "start", "end").agg(F.max(same.cast("double")).alias("label")))
    return rows.join(met, ["__key", "kind", "start", "end"], "left").select(
        *rows.columns, F.coalesce("label", F.lit(0.0)).alias("label"), F.col("label").isNull().alias("free"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def disguises(kind: str) -> list[Column]:
    """The forms of a base span ``s`` that only the generators find."""
    s = F.col("s")
    if kind == "email":
        local, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        return [F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in AT_DOT]
    if kind == "ip":
        return [F.replace(s, F.lit("."), F.lit(dot)) for dot in DOTS]
    if kind == "card":
        return [F.regexp_replace(_digits(s), "([0-9]{4})(?=[0-9])", "$1" + x) for x in CARD_SEPARATORS]
    plain = F.ltrim(s, F.lit("+"))
    national = F.regexp_replace(plain, "^[0-9]{1,3}[^0-9]+(?=[0-9(])", "")
    return [plain, F.regexp_replace(s, r"^\+[0-9]{1,3}[^0-9(]*", ""),
            *[F.array_join(F.regexp_extract_all(n, F.lit("[0-9]+"), F.lit(0)), x) for n in (plain, national) for x in PHONE_SEPARATORS]]


def counterfeits(kind: str) -> list[Column]:
    """What looks like a disguised span without being one, made from the digits
    of a base span ``s`` or from the words before it."""
    s, d = F.col("s"), _digits(F.col("s"))
    n = lambda i, mod: F.pmod(F.xxhash64("s", F.lit(i)), F.lit(mod))
    if kind == "email":
        words = F.concat(F.regexp_extract_all("before", F.lit("(?<![a-z])[a-z]{2,}"), F.lit(0)), *[F.array(F.lit(w)) for w in ("see", "this", "then")])
        w = [F.get(words, i) for i in range(3)]
        return [F.concat(w[0], F.lit(at), w[1], F.lit(". "), w[2]) for at in (" @ ", "@ ", " @")] + [
            F.concat(w[0], F.lit(at), n(1, 24).cast("string"), F.lit("."), (n(2, 50) + 10).cast("string")) for at in (" @ ", " @")]
    if kind == "ip":
        high = [F.array_join(F.array(*[(n(i, 999) if i else n(0, 744) + 256).cast("string") for i in range(4)]), x) for x in (".", *DOTS)]
        return high + [F.array_join(F.array(*[(n(1, 6) + 1 + i).cast("string") for i in range(4)]), x) for x in DOTS]
    if kind == "card":
        last = F.pmod(F.substring(d, -1, 1).cast("int") + 1 + n(1, 9).cast("int"), F.lit(10)).cast("string")
        wrong = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), last)
        return [wrong, *[F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1" + x) for x in CARD_SEPARATORS]]
    two = lambda i, mod: F.lpad((n(i, mod) + 1).cast("string"), 2, "0")
    year, three = (n(1, 90) + 1940).cast("string"), [(n(i, 900) + 100).cast("string") for i in range(4)]
    return [d, F.substring(d, -8, 8), F.concat(F.lit("0."), d),
            *[F.array_join(F.array(year, two(2, 12), two(3, 28)), x) for x in ("-", ".", "/")],
            *[F.array_join(F.array(two(3, 28), two(2, 12), year), x) for x in ("-", ".", "/")],
            F.concat_ws("-", year, year), F.concat_ws(" - ", year, year),
            *[F.array_join(F.array((n(4, 90) + 1).cast("string"), *three[:k]), x) for k in (2, 3) for x in (" ", ".")]]


def variants(kind: str, rows: DataFrame, made: list[Column], label: float, most: int = 3) -> DataFrame:
    """``rows`` with ``most`` of the ``made`` texts for ``s``, those that the
    kind's generator proposes as a whole and that are not the base form."""
    pattern = PROPOSE.get(kind, PROPOSE["number"])
    start = F.pmod(F.xxhash64("__key", "start", F.lit(label)), F.lit(len(made))).cast("int")
    picked = F.array(*[F.get(F.array(*made), F.pmod(start + i, F.lit(len(made)))) for i in range(min(most, len(made)))])
    out = rows.withColumn("__was", F.col("s")).withColumn("s", F.explode(F.array_distinct(picked))).withColumn("label", F.lit(label))
    bare = (F.length("s") == F.length(_digits(F.col("s")))) if kind == "phone" and label else F.lit(False)
    return out.filter((F.col("s") != F.col("__was")) & F.col("s").rlike(f"^(?:{pattern})$") & ~bare).drop("__was")


def impossible() -> Column:
    """Proposals that are no personal data of their kind, however written."""
    s, kind = F.col("s"), F.col("kind")
    n = F.length(_digits(s))
    glued = F.col("before").rlike(r"[\p{L}\p{N}]$") | F.col("after").rlike(r"^[\p{L}\p{N}]")
    return F.coalesce(F.when(kind == "email", ~F.substring_index(_plain_mail(s), ".", -1).rlike("[a-z]"))
                      .when(kind == "ip", ~octets(s)).when(kind == "card", ~luhn(_digits(s)) | (n > 19))
                      .otherwise(~n.between(7, 15)) | glued, F.lit(False))


def _plain_mail(s: Column) -> Column:
    at = F.regexp_replace(F.lower(s), r"\x20?(?:@|[(\[]at[)\]])\x20?", "@")
    return F.regexp_replace(at, r"\x20?(?:\.|[(\[]dot[)\]])\x20?", ".")


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of proposals (kind, s, before, after). What
    an email's name and host consist of says nothing about its being one, so
    only the last label and the separators count there."""
    s, before, after = F.col("s"), F.col("before"), F.col("after")
    d = _digits(s)
    mail = F.col("kind") == "email"
    count = lambda chars: (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")
    group = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))
    numeric = {
        "digits": F.length(d), "dots": count("."), "dashes": count("-"), "slashes": count("/"), "brackets": count("()"),
        "groups": F.size(group), "first_group": F.get(group, 0), "last_group": F.element_at(group, -1), "longest_group": F.array_max(group),
    }
    tail = F.substring_index(_plain_mail(s), ".", -1)
    cols = {
        **{k: F.when(~mail, c) for k, c in numeric.items()},
        "blanks": count(" "), "blank_dot": F.contains(s, F.lit(" .")), "dot_blank": F.contains(s, F.lit(". ")) & ~F.contains(s, F.lit(" .")),
        "marked": F.when(mail, s.rlike(r"[(\[](?:at|dot)[)\]]")),
        "tail": F.when(mail, F.length(tail)), "tail_letters": F.when(mail, tail.rlike("^[a-z]+$")),
        "luhn": F.when(F.col("kind") == "card", luhn(d)), "octets": F.when(F.col("kind") == "ip", octets(s)),
        "glued_before": before.rlike(r"[\p{L}\p{N}]$"), "glued_after": after.rlike(r"^[\p{L}\p{N}]"),
        "more_after": after.rlike(r"^[.,-]?[0-9]"),
        **{f"near_{i}": F.contains(before, F.lit(w)) for i, w in enumerate(CONTEXT)},
    }
    return rows.withColumns({f"f_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in cols.items()}), [f"f_{k}" for k in cols]


def extra_spans(found: DataFrame, least: int = 1, quiet: float = 0.999, floor: float = 0.9,
                rounds: int = 8, depth: int = 3, seed: int = 8) -> DataFrame:
    """(__key, __extra): the proposals that the trees add, per row key, from
    ``found`` (__key, __base, __seen). The trees are fitted on all base spans and
    invalid proposals of each kind; ``least`` is the number of base spans of a
    kind kept out of the fit that it needs."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = found.filter(F.size("__seen") > 0).select("__key", F.explode("__seen").alias("x")).select("__key", "x.*")
    span = F.struct("kind", "start", "end")
    rows = materialize(_compared(rows, found.select("__key", F.explode("__base").alias("b")).select("__key", "b.*")), "proposals")
    none = rows.select("__key", F.array(span).cast(SPAN).alias("__extra")).limit(0)
    # base spans, and free proposals that cannot be valid; the other free ones are in neither class
    known = rows.filter((F.col("label") == 1) | (F.col("free") & impossible()))
    base = known.filter("label = 1")
    part = F.pmod(F.xxhash64("__key", "start", "kind"), F.lit(3))
    # counted before anything is fitted: without a base span to judge by nothing is added for a kind
    kinds = [r["kind"] for r in base.filter(part == 0).groupBy("kind").count().collect() if r["count"] >= least]
    chosen, assembler = [], None
    for kind in [k for k in KINDS if k in kinds]:
        own = F.col("kind") == kind
        examples, names = features(
            variants(kind, base.filter(own), disguises(kind), 1.0)
            .unionByName(variants(kind, base.filter(own), counterfeits(kind), 0.0))
            .unionByName(known.filter(own & (F.col("label") == 0))))
        assembler = assembler or VectorAssembler(inputCols=names, outputCol="v")
        examples = materialize(assembler.transform(examples).withColumn("part", part).select("kind", "label", "part", "v"), "proposal-examples")
        fit_rows = examples.filter("part <> 0")
        if {r["label"] for r in fit_rows.select("label").distinct().collect()} != {0.0, 1.0}:
            continue
        trees = GBTClassifier(labelCol="label", featuresCol="v", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(fit_rows)
        p = vector_to_array("probability")[1]
        # above what nearly all negatives get; at least half of the positives must lie there
        held = materialize(trees.transform(examples.filter("part = 0")).select("label", p.alias("p")), "proposal-held")
        at = held.agg(F.percentile_approx(F.when(F.col("label") == 0, F.col("p")), quiet)).first()[0]
        limit = max(floor, at or 0.0)
        passed = held.filter("label = 1").agg(F.count("p").alias("n"), F.sum((F.col("p") > limit).cast("int")).alias("over")).first()
        if passed["n"] < least or 2 * passed["over"] < passed["n"]:
            continue
        described = assembler.transform(features(rows.filter(own & F.col("free")))[0])
        chosen.append(trees.transform(described).filter(p > limit).select("__key", "kind", "start", "end"))
    if not chosen:
        return none
    chosen = functools.reduce(DataFrame.unionByName, chosen)
    # of overlapping ones the first stays
    ordered = F.sort_array(F.collect_set(F.struct("start", "end", "kind")))
    apart = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), _no_spans().alias("out")),
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).alias("out"))).otherwise(a),
        lambda a: a["out"])
    return chosen.groupBy("__key").agg(apart.alias("__extra"))


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _text_of(spans: Column) -> Column:
    order = F.expr("map('email', 0, 'ip', 1, 'card', 2, 'phone', 3)")
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        order[x["kind"]].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256 and spans of every row of
    ``docs`` (doc_id, text)."""
    found = materialize(find(docs.select("doc_id", "text").withColumn("__key", row_key())).drop("text"), "found")
    extra = materialize(extra_spans(found), "extra")
    rows = found.join(extra, "__key", "left")
    every = F.concat("__base", F.coalesce("__extra", _no_spans()))
    kinds = F.col("__base.kind")
    n = [(F.size("__base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *n, F.sha2(_text_of(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                       _text_of(every).alias("spans"))


@other_columns_aside("doc_id", "text")
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) with every span of its text replaced by its kind
    in brackets; overlapping spans become one."""
    names = docs.columns
    # the texts are searched once: they are written with what was found
    found = materialize(find(docs.withColumn("__key", row_key())), "found")
    extra = materialize(extra_spans(found.select("__key", "__base", "__seen")), "extra")
    rows = found.drop("__seen").join(extra, "__key", "left")
    every = F.array_sort(F.transform(
        F.concat("__base", F.coalesce("__extra", _no_spans())),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("text")
    cut = F.aggregate(
        every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]),
                                                   F.lit("["), F.upper(x["kind"]), F.lit("]")))
            .otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return (rows.withColumn("text", F.when(F.size("__base") + F.size(F.coalesce("__extra", _no_spans())) > 0, cut)
                            .otherwise(text))
            .select(*[F.col(f"`{c}`") for c in names]))
