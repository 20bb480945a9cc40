import pytest


def thue_morse(size):
    """Two different texts of a and b that share every polynomial hash that wraps around, from
    1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def kept(spark, tmp_path_factory):
    """A frame written and read again, so that every scan gives the same rows in order."""

    def keep(rows, schema=SCHEMA, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "t")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return keep


@pytest.fixture(scope="session")
def docs(kept):
    """Documents from (id, text) pairs or texts."""

    def make(texts, **more):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return kept([(i, t, "en", "src1", None) for i, t in pairs], **more)

    return make


@pytest.fixture(scope="session")
def awkward(kept):
    """Null ids, texts and languages, empty and long texts, ties, repeated rows, and extra
    columns named like results and working columns."""
    text = "The quick brown fox jumps over the lazy dog again and again. "
    rows = [
        (1, None, None, None),
        (2, "", "en", "src0"),
        (3, " \t\n", "en", "src0"),
        (4, "word", "en", "src11"),
        (5, text * 3, "en", "src0"),
        (6, text * 3, "fr", "src0"),
        (6, text * 3, "fr", "src0"),
        (6, text * 3, "fr", "src0"),
        (None, text * 3, "de", None),
        (None, None, "de", "src12"),
        (7, text.upper() * 3, "en", "src2"),
        (8, text * 2000, "en", "src0"),
        (9, "x" * 70_000, "es", "src3"),
        (10, "1 " * 20_000, "es", "src3"),
        (11, "ünï©ødé 漢字 😀 " * 30, "es", "src3"),
        (None, None, "de", "src12"),
    ]
    extra = ["kept", "KEEP_ID", "row", "key", "id", "label", "score", "spans", "removed", "tokens", "epoch", "a.b", "first", "ids"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in extra)
    return kept([(*r, *[f"{c}!" for c in extra]) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(kept):
    return kept([], parts=1)
