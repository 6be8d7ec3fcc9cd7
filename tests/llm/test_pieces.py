"""SentencePiece: ids and decoded texts against the library."""

import hashlib
import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from bookrisk.llm import pieces

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(vocabulary, n):
    r, every = random.Random(4), list(vocabulary.pieces)
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            yield "".join(r.choice(" ▁ a\n\t") if r.random() < 0.7 else r.choice(every) for _ in range(r.randint(1, 60)))
        elif kind < 0.6:
            yield "".join(r.choice(every) for _ in range(r.randint(1, 8)))
        elif kind < 0.8:
            yield " " * r.randint(0, 70) + r.choice(["", "the", "x"]) + " " * r.randint(0, 70)
        else:
            yield "".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0x2580, 0x2590), r.randint(0, 0xD7FF), r.randint(0x10000, 0x1F9FF)]))
                          for _ in range(r.randint(0, 30)))


def encoded(vocabulary, texts):
    ids, ends = pieces.Encoder(vocabulary).encode(texts)
    return [ids[a:b].to_pylist() for a, b in itertools.pairwise(ends.tolist())]


def test_ids_equal_the_library(vocabulary, library):
    texts = list(odd_texts(vocabulary, 6000))
    for t, got in zip(texts, encoded(vocabulary, texts), strict=True):
        assert got == library.encode(t), t


def test_small_memories_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    monkeypatch.setattr(pieces, "WINDOW", 5)
    texts = [t + " the cat the cat" for t in odd_texts(vocabulary, 300)]
    assert encoded(vocabulary, texts) == [library.encode(t) for t in texts]


def test_compatible_is_what_merging_leaves(vocabulary):
    def merged(s):
        parts = list(s)
        while (k := vocabulary.best(parts)) is not None:
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts
    r, ids = random.Random(2), list(vocabulary.pieces.values())
    joining = [p for p in vocabulary.pieces if len(p) > 3]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(1500)]
    for p in r.sample(joining, 1500):  # borders inside a piece, where merges do cross
        k = r.randrange(1, len(p))
        if p[:k] in vocabulary.pieces and p[k:] in vocabulary.pieces:
            pairs.append((vocabulary.pieces[p[:k]], vocabulary.pieces[p[k:]]))
    seen = [vocabulary.compatible(a, b) for a, b in pairs]
    assert seen == [merged(vocabulary.text[a] + vocabulary.text[b]) == [vocabulary.text[a], vocabulary.text[b]] for a, b in pairs]
    assert 100 < sum(seen) < len(pairs) - 100


def test_rows_and_edges(spark, vocabulary, library):
    texts = [None, "", " ", "  a  b ", "same", "same", "x\n\n y\t", "日本 𝔘 ⁇ <s>", "no" * 200_000, "word " * 50_000, " " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "left out")], "doc_id long, text string")
    df = df.withColumns({"ids": F.lit(1), "decoded": F.lit("z"), "n_tokens": F.lit(0)})
    got = {r["doc_id"]: r for r in pieces.round_trip(df, vocabulary).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "left out")]:
        want = library.encode(t or "")
        assert got[i]["ids"] == want and got[i]["decoded"] == library.decode(want)
    assert pieces.round_trip(df.limit(0), vocabulary).count() == 0


def test_decoding_of_any_ids(spark, vocabulary, library):
    r = random.Random(3)
    rows = [[r.choice([r.randint(3, 258), r.randint(0, 31999), 28705, 35, 0]) for _ in range(r.randint(0, 12))] for _ in range(500)]
    rows += [[1, 28705, 28705], [2, 1], [0, 28705]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, ids array<int>")
    got = [x[0] for x in df.orderBy("i").select(pieces.decoder(spark, vocabulary)(F.col("ids"))).collect()]
    assert got == [library.decode(x) for x in rows]
    odd = spark.sql("select cast(null as array<int>) as ids union all select array(261, null, 28707)")
    assert sorted(x[0] for x in odd.select(pieces.decoder(spark, vocabulary)(F.col("ids"))).collect()) == ["", library.decode([261, 28707])]


def test_query_over_the_table(spark, library):
    from bookrisk.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "")
        assert (got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.vocabulary(str(tmp_path / "m.model"))
