import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

from vecengine.llm import byte_bpe, common, pieces, token_counts, token_files
from vecengine.llm.pieces import PieceTable

BPE, FILES, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_byte_bpe_is_tiktoken(spark, odd, odd_rows):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    want = Counter()
    for i, t in odd_rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.encode_documents(odd, BPE, P.PATTERN).collect()) == want


def test_tree_is_the_direct_encoding():
    bpe, rng = byte_bpe.coder(BPE, P.PATTERN), random.Random(3)
    for alphabet in (b"ab", b"the", bytes(range(256)), "éàß日".encode(), b"0"):
        for n in (0, 1, 2, 3, 17, 64, 300):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert bpe.tree(data) == bpe.leaf(data)


def test_join_of_any_halves():
    bpe, rng = byte_bpe.coder(BPE, P.PATTERN), random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice(["tion", "s", "ch", "ei", "ü", "a", "aa", "1"]) for _ in range(12)).encode()
        cut = rng.randrange(len(data) + 1)
        assert bpe.join(bpe.leaf(data[:cut]), bpe.leaf(data[cut:])) == bpe.leaf(data)


def test_piece_table_renews_and_joins():
    table, rng = PieceTable(lambda xs: [x.encode("utf-32-le") for x in xs], "<u4", 5), random.Random(1)
    for _ in range(50):
        texts = ["".join(rng.choice(["ab", " ", "  ", ",", "\n", "é", "\x1c", "1", ""]) for _ in range(20)) for _ in range(3)] + [""]
        assert [x.decode("utf-32-le") for x in table.encode(texts)] == texts


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    """Whatever the hash, a hit counts only if the characters agree; long pieces are encoded as they come."""
    real, rng = pieces.hashed, random.Random(7)
    monkeypatch.setattr(pieces, "hashed", lambda codes, starts, lens: real(codes, starts, lens) % np.uint64(5))
    table = PieceTable(lambda xs: [x.encode("utf-32-le") for x in xs], "<u4", 20)
    for _ in range(50):
        texts = ["".join(rng.choice(["ab", "ba", " ", ",", "\n", "é", "1", "y" * 300]) for _ in range(20)) for _ in range(3)]
        assert [x.decode("utf-32-le") for x in table.encode(texts)] == texts


def test_pieces_of_odd_white_space_are_the_tokenizers():
    tokenizer, table, rng = token_files.load_tokenizer(FILES), token_files._encoder(FILES, "<u2"), random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "!", "'s", "12", "%%", "\x1c", "😀", "\u3000", "ab,", "'", ".", "\r\n", "²", "'ll", "\u0301", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in table.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def expected_files(rows):
    tokenizer, start, out = token_files.load_tokenizer(FILES), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, odd_rows, nothing, tmp_path):
    folder = f"file://{tmp_path}/a"
    token_files.write_token_files(odd, folder, FILES, 2)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder, FILES).collect()), key=lambda r: r[1])
    assert got == expected_files(odd_rows)
    assert not list(tmp_path.glob("a/*.tmp"))
    least = spark.createDataFrame([(-(1 << 63), "a"), (None, "b")], "doc_id long, text string")
    token_files.write_token_files(least, f"file://{tmp_path}/c", FILES, 2)
    assert sorted((r.doc_id for r in token_files.read_token_files(spark, f"file://{tmp_path}/c", FILES).collect()), key=str) == [-(1 << 63), None]
    assert token_files.write_token_files(nothing, f"file://{tmp_path}/b", FILES, 2).count() == 0
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b", FILES).count() == 0


def best_segmentations(word, scores, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        options.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(word[end - 1].encode())))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark, odd, odd_rows, nothing):
    scores = token_counts.fit_scores(odd, PIECES)
    unknown = min(scores.values()) - 10 * token_counts.UNIT
    got = sorted((tuple(r) for r in token_counts.count_tokens(odd, scores).collect()), key=str)
    want = []
    for i, t in odd_rows:
        words = token_counts.PRETOKEN.findall(token_counts.MARK + t.replace(" ", token_counts.MARK)) if t else []
        want.append((i, len(words), sum(n if len(w) > 1000 else best_segmentations(w, scores, unknown) for w in words for n in [long_count(w, scores, unknown) if len(w) > 1000 else 0])))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(nothing, scores).count() == 0
    assert len(set(token_counts.fit_scores(nothing, PIECES).values())) == 1


def test_unigram_scores(spark):
    """Scores are those of the library's own counts, whatever the partitions; frequent words get fewer tokens; counts are near the library's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.where("text IS NOT NULL").collect()]
    own = {i: model.encode(t) for i, t in rows}
    counts = Counter(x for ids in own.values() for x in ids)
    got = {r.piece: r.n for r in token_counts.piece_counts(docs.repartition(5), PIECES).collect()}
    assert got == dict(counts)
    scores = token_counts.fit_scores(docs, PIECES)
    assert abs(sum(np.exp(x / token_counts.UNIT) for x in scores.values()) - 1) < 1e-3 and max(scores.values()) < 0
    counter = token_counts.TrieCounter(scores)
    by_word = Counter(w for _, t in rows for w in t.split(" ") if w.isalpha())
    ordered = [w for w, _ in by_word.most_common()]
    mean = lambda ws: sum(counter.count_all(ws)[1]) / len(ws)
    assert mean(ordered[:100]) < 0.6 * mean(ordered[-2000:])
    total = sum(counter.count_all([t for _, t in rows])[1])
    assert 0.95 < total / sum(map(len, own.values())) < 1.05


def long_count(word, scores, unknown):
    """As above, with pieces of at most their greatest length."""
    longest, best = max(map(len, scores)), [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        options.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(word[end - 1].encode())))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_path(spark, "x").startswith(common.shared_base(spark))
