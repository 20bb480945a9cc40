import random
import weakref

from pyspark.sql import DataFrameWriter
from tokenizers import Tokenizer

import corpus_pipeline
from llm import bpe, mixing, toxicity
from llm.common import in_worker
from llm.hashing import Digests
from llm.jaccard_join import shingle_sets
from tests.llm.test_jaccard_join import by_hand as components_by_hand
from tests.llm.test_mixing import by_hand as mix_by_hand


def test_run_against_a_plain_version(spark, kept, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            words[3] = "zorgon"
        if i % 10 == 9:
            words = rows[i - 5][1].split()
            words[0] = words[0].upper() if i % 20 == 9 else word()
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None]), f"src{rng.randrange(14)}", None))
        labels.append((i, int("zorgon" in rows[i][1])))
    rows += [(1000, None, "en", "src1", None), (1001, "", "en", "src1", None), (None, "lost and found", "en", "src1", 3)]
    folder = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")

    lexicon = toxicity.learned(spark, folder)
    clean = [r for r in rows if toxicity.strength(r[1], lexicon) < lexicon.threshold]
    assert 30 <= len(rows) - len(clean) <= 60 and not any("zorgon" in (r[1] or "") for r in clean)
    last = {}
    for r in sorted(clean, key=lambda r: -1 if r[0] is None else r[0]):
        last[(r[1] or "").lower()] = r
    component = components_by_hand([(-1 if r[0] is None else r[0], r[1]) for r in last.values()])
    near = [r for r in last.values() if component[-1 if r[0] is None else r[0]][1] == (-1 if r[0] is None else r[0])]
    tree = [(r[0], r[1], "curated" if int(r[3][3:]) >= 10 else "web", r[2], r[3]) for r in near]
    drawn = mix_by_hand(
        [(i if i is not None else "null", *rest) for i, *rest in tree], mixing.WEIGHTS, corpus_pipeline.SHARE, 1, mixing.SEED
    )
    tokens = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {str(r[0]) if r[0] is not None else "null": r[1] or "" for r in rows}
    expected = sorted((str(d), len(tokens.encode(texts[str(d)], add_special_tokens=False).ids)) for d, *_ in drawn)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(("null" if r["doc_id"] is None else str(r["doc_id"]), r["n_tokens"]) for r in got) == expected


def test_a_worker_keeps_what_one_stage_learnt_not_all():
    model = weakref.ref(bpe.load(bpe.VOCABULARY))
    list(model().encode(["some words"]))
    assert bpe.load(bpe.VOCABULARY) is model()
    shingle_sets([memoryview(b"a b c d e f")])
    assert model() is None
    words = weakref.ref(in_worker(Digests))
    assert b"a" in words()
    assert toxicity.matches(" fool ", toxicity.Lexicon(((" fool ", 2.0),))) == [(0, " fool ", 2.0)]
    assert words() is None


def test_near_copies_drop_the_shuffles_of_signatures_and_texts(spark, docs, monkeypatch):
    written, parquet = [], DataFrameWriter.parquet

    def noted(self, *args, **more):
        written.append((self._df.columns, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")))
        return parquet(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(12)]
    given = docs([*texts, *[f"{t} more" for t in texts[:4]]])
    written.clear()
    assert corpus_pipeline.drop_near_copies(spark, given, "").count() == 12
    assert next(dropped for columns, dropped in written if columns == ["u", "v"]) == "true"
    assert [dropped for columns, dropped in written if columns == ["a", "b", "links"]] == ["true"]
