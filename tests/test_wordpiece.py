"""Word pieces against a plain longest-match loop and against the tokenizers library."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import wordpiece
from parlance.functions.wordpiece import WordPieces
from parlance.operators import chunk

PIECES = ["a", "ab", "abc", "b", "##a", "##b", "##bc", "##c", "c", "é", "ü", "un", "##known", "know", ".", ",", "-", "日", "##", "#"]


def by_loop(word, pieces):
    if len(word) > 100:
        return 1
    at, n = 0, 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in pieces and (at or not word[at:e].startswith("##") or word[at:e] == "##")]
        if not ends:
            return 1
        at, n = ends[0], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcéü#kn", max_size=8), max_size=20))
def test_longest_match_of_a_batch(words):
    assert WordPieces(PIECES).counts(words).tolist() == [by_loop(w, set(PIECES)) for w in words]


def test_edges():
    v = WordPieces(PIECES)
    assert v.counts(["", "a" * 100, "a" * 101, "x", "unknown", "abcabc"]).tolist() == [0, 100, 1, 1, 2, 3]  # abcabc: abc, ##a, ##bc
    assert WordPieces([]).counts(["a", ""]).tolist() == [1, 0] and v.counts([]).tolist() == []
    assert v.count_texts([None, "", "  ", "Ab\x00c, 日日 É", "x"]) == [0, 0, 0, 5, 1]


def test_words_as_the_tokenizers_library_finds_them():
    from tokenizers import normalizers, pre_tokenizers

    normal, split = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    rng = random.Random(1)
    letters = "aB é Éü ß . , ' $ ~ _ - \t \n\x00\x07​� 日本 İ ǅ ñ 𝔸 ½ ¡ €   　 ﬁ"
    for _ in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        assert wordpiece.words_of(t) == [w for w, _ in split.pre_tokenize_str(normal.normalize_str(t))], repr(t)


def test_counts_as_the_tokenizers_library_counts(tmp_path):
    from tokenizers import BertWordPieceTokenizer

    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", *PIECES]))
    theirs, ours = BertWordPieceTokenizer(str(path), lowercase=True), WordPieces(PIECES)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcéükn.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(9))) for _ in range(500)]
    assert ours.count_texts(texts) == [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_by_pieces(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(PIECES))
    v = wordpiece.read_vocabulary(spark, str(tmp_path / "v.txt"))
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) + rng.choice(("", "", ". A", "!")) for _ in range(rng.randrange(40)))) for i in range(60)] + [(90, None), (91, " \n ")]
    df = spark.createDataFrame(rows, "segment_id long, segment_text string").withColumn("segment_id", F.col("segment_id").cast("string"))
    got = {r.chunk_id: (r.chunk_text, r.n_tokens) for r in chunk.chunk(df, 9, v.count_texts).collect()}
    want = {}
    for i, t in rows:
        for k, c in enumerate(chunk.chunks(t, 9, lambda x: sum(by_loop(w, set(PIECES)) for w in wordpiece.words_of(x))), 1):
            want[f"{i}_c{k}"] = c
    assert got == want and len(want) > 60


def test_a_vocabulary_is_bounded(monkeypatch):
    monkeypatch.setattr(wordpiece, "MOST_PIECES", 3)
    try:
        WordPieces("abcd")
    except ValueError:
        return
    raise AssertionError
