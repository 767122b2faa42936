"""The pipeline, every stage and run(), against plain Python."""

import random

import corpus_pipeline
import plain
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
R = random.Random(5)
WORDS = [a + b for a in "quick lamp river stone under garden".split() for b in "a e i o an el ar is".split()]


def prose(n=80):
    return " ".join((R.choice(WORDS) if R.random() < 0.7 else R.choice(["the", "of", "and"])) + ("." if i % 9 == 8 else "") for i in range(n))


def corpus():
    """(documents, benchmark texts) with copies, shared lines, leaks, junk, nulls, empty and long texts, repeated rows."""
    R.seed(5)
    passage, item = [prose(12) for _ in range(4)], prose(25)
    rows = [prose() for _ in range(60)] + [prose(8000), None, "", " \n\t ", "few words"]
    rows += ["\n".join([prose(60), *passage, prose(30)]) for _ in range(4)] + ["\n".join(passage * 3)]
    copy = prose(120).split()
    rows += [" ".join(copy)] * 3 + [" ".join(copy[:60] + ["changed"] + copy[61:]), " ".join(copy).upper()]
    rows += [prose(50) + " " + item + " " + prose(50), prose(60) + " " + " ".join(item.split()[5:16]) + "\n" + prose(40)]
    rows += [" ".join(w + "###" for w in prose().split()) for _ in range(8)] + [" | ".join(R.choice(WORDS) for _ in range(90)) for _ in range(8)]
    docs = list(enumerate(rows)) + [(3, rows[3]), (None, prose()), (None, None)]
    return docs, [item, None, "", "Zz qq"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    docs, items = corpus()
    rows = [(i, t, "en", "src", None if t is None else len(t), 7) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage_and_the_whole(spark, folder):
    import sentencepiece

    docs, items = corpus()
    plainly = [plain.kept_by_quality, plain.without_repeated_lines, plain.one_of_each, lambda d: plain.clean_of(d, items)]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = df.columns, [len(docs)]
    for (name, stage), f in zip(corpus_pipeline.STAGES[:-1], plainly, strict=True):
        df, docs = stage(spark, df, folder).cache(), f(docs)
        assert df.columns == columns, name
        assert rows_of(df) == sorted(docs, key=str), name
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 50
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, len(sp.encode(t)), sp.encode(t), True) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.n_pieces, r.ids, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == want


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
