"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Patterns find the protected entities: e-mail and network addresses, card and phone
numbers. Words of the same text can give the entity away after it is masked. How strongly
they do is estimated from the corpus: the pointwise mutual information of word and entity
over the entity's information content. Words above one threshold are generalised, above
another removed, wherever they stand in a text with the entity. An entity is also counted
by what it has in common with others (domain, network, number prefix), so that the words
around one that stands in a single text can still be judged.

Whatever grows with a text's matches is rows, not arrays: spans are found, resolved and
replaced in blocks of the text, so time stays in proportion to texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import documents, quoted, stored, without

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Different texts that must hold both word and entity. In a single text every word that
#: stands nowhere else would give all of the entity, so one text is no evidence.
SUPPORT = 2
#: Share of the entity's information from which a word is generalised, and removed.
GENERALISE, REMOVE = 0.6, 0.9
#: What entities have in common is judged where at most this share of the texts holds it: more
#: common, it tells little about anyone.
COMMON = 0.05
#: Code points of a text that are replaced at once.
BLOCK = 1024

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The kinds' patterns, written so that a match can only begin where the leftmost match of
# the plain pattern does, and never tries a run of characters twice: time stays in
# proportion to the text. A card's pattern takes whole chains of digits only, of a length
# that can pass.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?:[0-9][\x20-]?){13,18}[0-9](?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_WORD = r"\p{L}[\p{L}\p{M}]*"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum of card numbers."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, digit).otherwise(digit * 2)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(rank: Column, value: Column) -> Column:
    """Whether a pattern's match is an entity of its kind."""
    tests = {
        "ip": value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
        "card": _luhn(_digits(value)),
        "phone": F.length(_digits(value)).between(10, 15),
    }
    passed = F.lit(True)
    for kind, test in tests.items():
        passed = F.when(rank == KINDS.index(kind), test).otherwise(passed)
    return passed


def _entity(kind: Column, value: Column) -> Column:
    """One name for all spellings of an entity."""
    plain = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value))
    return F.concat(kind, F.lit(":"), plain)


def _levels(entity: Column) -> Column:
    """The entity's name and those of what it has in common with others."""
    common = (
        ("^email:[^@]*", "email:"),
        (r"^email:.*?([^.@]+\.[^.@]+)$", "email:@$1"),
        (r"^(ip:.*\.)[0-9]+$", "$1*"),
        (r"^(ip:.*\.)[0-9]+\.[0-9]+$", "$1*"),
        ("^(card:[0-9]{6}).*$", "$1*"),
        ("^(phone:.*)[0-9]{4}$", "$1*"),
    )
    return F.array(entity, *[F.regexp_replace(entity, pattern, by) for pattern, by in common])


def _is_common(entity: Column) -> Column:
    return entity.startswith("email:@") | entity.endswith("*")


def _disjoint(spans: DataFrame) -> DataFrame:
    """Spans without what an earlier one of their row covers; ``by`` stays where they begin."""
    before = Window.partitionBy("_row").orderBy("s", "rank", "e").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("_reach", F.coalesce(F.max("e").over(before), F.lit(0)))
        .where("e > _reach")
        .withColumn("by", F.when(F.col("s") >= F.col("_reach"), F.col("by")).otherwise(""))
        .withColumn("s", F.greatest("s", "_reach"))
        .drop("_reach")
    )


def _replaced(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(_row, _out): ``_text`` with ``by`` in place of each span, blanks where ``by`` is null.

    ``spans`` don't overlap. Text and spans are cut into blocks, which meet by their number.
    """
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    blocks = texts.select("_row", F.posexplode(pieces).alias("_block", "_piece"))
    first, last = F.expr(f"cast(s div {BLOCK} as int)"), F.expr(f"cast((e - 1) div {BLOCK} as int)")
    cuts = (
        spans.select("_row", "s", "e", "by", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_block"))
        .withColumns(
            {
                "s": F.greatest(F.col("s") - F.col("_block") * BLOCK, F.lit(0)),
                "e": F.least(F.col("e") - F.col("_block") * BLOCK, F.lit(BLOCK)),
            }
        )
        .withColumn(
            "by",
            F.when(F.col("by").isNull(), F.repeat(F.lit(" "), F.col("e") - F.col("s")))
            .when(F.col("_block") == F.col("_first"), F.col("by"))
            .otherwise(""),
        )
        .groupBy("_row", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("s", "e", "by"))).alias("_cuts"))
    )

    def add(done: Column, x: Column) -> Column:
        gap = F.substring(F.col("_piece"), done["at"] + 1, x["s"] - done["at"])
        return F.struct(x["e"].alias("at"), F.concat(done["out"], gap, x["by"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(F.col("_piece"), done["at"] + 1, F.lit(BLOCK)))
    made = F.when(F.col("_cuts").isNull(), F.col("_piece")).otherwise(F.aggregate("_cuts", zero, add, rest))
    done = blocks.join(cuts, ["_row", "_block"], "left").select("_row", F.struct("_block", made.alias("out")).alias("x"))
    return done.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("x"))["out"], "").alias("_out"))


def _said(text: Column) -> Column:
    """The words of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def _words(found: DataFrame) -> DataFrame:
    """(_row, term), once for each word of a row outside its spans."""
    return found.select("_row", F.explode(F.array_distinct(_said(F.col("_masked")))).alias("term"))


def _matched(text: Column, rank: int, found: Column) -> Column:
    """A kind's matches in order: array of (rank, gap, hit), the gap being the number of code
    points since the match before."""
    gaps = F.transform(F.split(text, PATTERNS[KINDS[rank]], -1), F.char_length)
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        found,
        lambda gap, hit: F.struct(F.lit(rank).alias("rank"), gap.alias("gap"), hit.alias("hit")),
    )
    return F.when(F.size(found) > 0, pairs).otherwise(F.expr("cast(array() as array<struct<rank:int,gap:int,hit:string>>)"))


def find_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_spans``, ``_masked``, ``_key`` and ``_row``, stored.

    ``_spans``: (s, rank, e, kind, entity) of the patterns' matches, by start, then kind.
    ``_masked``: the text with blanks in place of them; ``_key``: a digest of the text;
    ``_row``: a number of the row's own. Only rows with a match are shuffled.
    """
    docs = without(docs, ["_text", "_spans", "_masked", "_key", "_row", "_hits", *[f"_{k}" for k in KINDS]])
    columns = [quoted(c) for c in docs.columns]
    text = F.coalesce(quoted(text_col), F.lit(""))
    frame = docs
    # Cheap tests first: few texts have the sign that a pattern needs.
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.expr("cast(array() as array<string>)")
    for kind in KINDS:
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        frame = frame.withColumn(f"_{kind}", F.when(needs[kind], hits).otherwise(none) if kind in needs else hits)
    hits = F.concat(*[_matched(text, i, F.col(f"_{k}")) for i, k in enumerate(KINDS)])
    frame = stored(
        frame.select(*columns, F.monotonically_increasing_id().alias("_row"), F.md5(text).alias("_key"), hits.alias("_hits")),
        compression="zstd",
    )
    some, none = frame.where(F.size("_hits") > 0), frame.where(F.size("_hits") == 0)
    # Matches and the text between them alternate: a running sum of lengths gives the places.
    upto = Window.partitionBy("_row", "rank").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    spans = stored(
        some.select("_row", F.posexplode("_hits").alias("_at", "_x"))
        .select("_row", "_at", "_x.*")
        .withColumn("e", F.sum(F.col("gap") + F.char_length("hit")).over(upto).cast("int"))
        .where(_passes(F.col("rank"), F.col("hit")))
        .select("_row", (F.col("e") - F.char_length("hit")).alias("s"), "rank", "e", kind.alias("kind"), "hit")
        .select("_row", "s", "rank", "e", "kind", _entity(F.col("kind"), F.col("hit")).alias("entity"))
    )
    listed = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("s", "rank", "e", "kind", "entity"))).alias("_spans")
    )
    blanks = _disjoint(spans.select("_row", "s", "rank", "e", F.lit(None).cast("string").alias("by")))
    # What only begins inside another span is cut, not marked by "": all of it is blank.
    masked = _replaced(some.select("_row", text.alias("_text")), blanks.withColumn("by", F.lit(None).cast("string")))
    no_spans = F.expr("cast(array() as array<struct<s:int,rank:int,e:int,kind:string,entity:string>>)")
    marked = stored(
        some.join(listed, "_row", "left")
        .join(masked, "_row")
        .select(*columns, F.coalesce("_spans", no_spans).alias("_spans"), F.col("_out").alias("_masked"), "_key", "_row"),
        compression="zstd",
    )
    return none.select(*columns, no_spans.alias("_spans"), text.alias("_masked"), "_key", "_row").union(marked)


def _entities(found: DataFrame) -> DataFrame:
    """(_row, entity), once for each entity of a row, and for what it has in common with others."""
    names = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.col("_spans.entity")), _levels)))
    return found.where(F.size("_spans") > 0).select("_row", F.explode(names).alias("entity"))


def disclosing_terms(found: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(entity, term, share): words that give an entity away, from counts over all texts.

    With n different texts, n_e of them with the entity, n_t with the word outside spans
    and n_te with both, wherever they stand: share = log(n_te * n / (n_t * n_e)) /
    log(n / n_e), the part of the entity's information that the word gives. Copies of a
    text count once. n_te must be ``SUPPORT``. What entities have in common counts as an
    entity, named by its pattern, where n_e is at most ``COMMON`` of n. All counts come from
    ``found``, which has a number ``_row`` in each row; ``docs`` is not read.
    """
    first = found.groupBy("_key").agg(F.min("_row").alias("_row"))
    copies = stored(found.select("_row").join(first, "_row", "left_anti"))
    texts = found.join(copies, "_row", "left_anti")
    n = texts.select("_row").count()
    held = _entities(texts)
    known = (
        held.groupBy("entity")
        .agg(F.count("*").alias("n_e"))
        .where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n))
        .where(~_is_common(F.col("entity")) | (F.col("n_e") <= COMMON * n))
    )
    held = stored(held.join(known, "entity"))
    most = held.agg(F.max("n_e")).first()[0] or 0
    # As n_te is n_e at most, a word of more texts than this can't reach the threshold.
    limit = lambda n_e: F.pow(n_e, F.lit(GENERALISE)) * F.pow(F.lit(n), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    counts = (
        _words(texts)
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
        .where((F.col("n_t") >= SUPPORT) & (F.col("n_t") <= limit(F.lit(most))))
    )
    holding = texts.where(F.size("_spans") > 0).join(held.select("_row").distinct(), "_row", "left_semi")
    beside = _words(holding).join(counts, "term")
    pairs = (
        held.join(beside, "_row")
        .where(F.col("n_t") <= limit(F.col("n_e")))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
        .where(F.col("n_te") >= SUPPORT)
    )
    share = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))
    return (
        pairs.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")
    )


def mark_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``found`` with spans, with ``_terms``: (s, e, share) of all the words that
    disclose an entity of the row, each with its largest share."""
    found = found.where(F.size("_spans") > 0)
    # An entity that many rows hold can have as many terms: only those that a row says are its own.
    terms = stored(terms)
    held = _entities(found).join(terms.select("entity").distinct(), "entity", "left_semi")
    said = (
        _words(found.join(held.select("_row").distinct(), "_row", "left_semi"))
        .join(terms.select("term").distinct(), "term", "left_semi")
    )
    told = stored(
        said.join(held, "_row").join(terms, ["entity", "term"]).groupBy("_row", "term").agg(F.max("share").alias("share"))
    )
    # Words and the text between them alternate: a running sum of lengths gives the places.
    gaps = F.transform(F.split("_masked", _WORD, -1), F.char_length)
    hits = F.regexp_extract_all("_masked", F.lit(_WORD), F.lit(0))
    pieces = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        hits,
        lambda gap, hit: F.struct(gap.alias("gap"), F.char_length(hit).alias("size"), F.lower(hit).alias("term")),
    )
    upto = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        found.select("_row", "_masked")
        .join(told.select("_row").distinct(), "_row", "left_semi")
        .select("_row", F.posexplode(pieces).alias("pos", "x"))
        .select("_row", "pos", "x.*")
        .withColumn("e", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
        .join(told, ["_row", "term"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("e") - F.col("size")).alias("s"), "e", "share"))).alias("_terms"))
    )
    none = F.expr("cast(array() as array<struct<s:int,e:int,share:double>>)")
    return found.join(marked, "_row", "left").withColumn("_terms", F.coalesce("_terms", none))


def _sanitised(marked: DataFrame) -> DataFrame:
    """(_row, _out): texts with entities masked by kind, words generalised to [WORD] or removed."""
    entities = marked.select("_row", F.explode("_spans").alias("x")).select(
        "_row", "x.s", "x.rank", "x.e", F.concat(F.lit("["), F.upper("x.kind"), F.lit("]")).alias("by")
    )
    words = marked.select("_row", F.explode("_terms").alias("x")).select(
        "_row", "x.s", F.lit(len(KINDS)).alias("rank"), "x.e", F.when(F.col("x.share") >= REMOVE, "").otherwise("[WORD]").alias("by")
    )
    # Outside its spans the masked text is the text.
    return _replaced(marked.select("_row", F.col("_masked").alias("_text")), _disjoint(entities.union(words)))


def sanitise(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``spans`` and, if ``with_text``, ``sanitised``; the order of
    rows isn't kept.

    ``spans``: array of (s, rank, e, kind) with code points, end exclusive, by start and
    kind; the patterns' spans come as they are, disclosing words as kind ``term``.

    Defined cases: a null text counts as empty and has no spans; equal rows get equal
    spans; an entity in every text has no information and no terms, and one in a single text
    has none either, however many copies it has, but those of its domain, network or number
    prefix; time grows with the number of matches of a text, not its square; an empty table
    gives an empty result; columns of ``docs`` named like a result column are replaced.
    """
    docs = without(docs, ["spans", "sanitised", "_row", "_terms", "_out"])
    columns = [quoted(c) for c in docs.columns]
    found = find_entities(docs, text_col)
    parts = [
        F.transform(
            "_spans", lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))
        ),
        F.transform(
            "_terms",
            lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("rank"), x["e"].alias("e"), F.lit(TERM).alias("kind")),
        ),
    ]
    marked = mark_terms(found, disclosing_terms(found)).withColumn("spans", F.array_sort(F.concat(*parts)))
    none = F.expr("cast(array() as array<struct<s:int,rank:int,e:int,kind:string>>)")
    plain = found.where(F.size("_spans") == 0).withColumn("spans", none)
    if not with_text:
        return plain.select(*columns, "spans").union(marked.select(*columns, "spans"))
    marked = stored(marked.select(*columns, "_row", "spans", "_spans", "_masked", "_terms"), compression="zstd")
    marked = marked.join(_sanitised(marked), "_row")
    return plain.select(*columns, "spans", F.col("_masked").alias("sanitised")).union(
        marked.select(*columns, "spans", F.col("_out").alias("sanitised"))
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != TERM)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count(TERM).alias("n_terms"),
        F.char_length("sanitised").cast("long").alias("sanitised_chars"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )
