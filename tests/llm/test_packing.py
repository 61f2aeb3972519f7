import itertools
import random
import zlib

import numpy as np
import pytest

from askloom.llm import packing as P

PATH = P.tokenizer_file()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_matches_the_library(plain):
    encode = P.encoder(PATH)
    texts = ["", "The cat, the CAT; don't!", "á b,", "ΑΣ ΣΑΣ.", "x y!", "İstanbul İ...", "<|ENDOFTEXT|> a<|endoftext|>b", "́ a b", "H̱. ²., ½! µ ǅ. É, ªb.", "A,b.C ..x 'S S'.'s _a_.", "日本語 テキスト。", "😀😀 a😀"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain(t), t


def test_fill_is_the_fullest(seed=3):
    rng = random.Random(seed)
    for _ in range(150):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 25)
        got = P.fill(sorted(counts, reverse=True), counts, room)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in got)


def test_plan_uses_everything_once():
    rng = random.Random(5)
    histogram = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(30)}
    lines = P.plan(histogram, 100)
    used = {}
    for pattern, bins in lines:
        assert sum(n * k for n, k in pattern) <= 100
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * bins
    assert used == histogram
    bins, least = sum(b for _, b in lines), -(-sum(n * c for n, c in histogram.items()) // 100)
    assert least <= bins <= least * 1.05 + 1
    assert P.plan({}, 10) == []


def test_encoder_matches_the_library_on_random_parts(plain):
    rng, encode = random.Random(8), P.encoder(PATH)
    for _ in range(4000):
        part = "".join(rng.choice("abcdezxéèßñüöàçøÿªºµÆÉŒœıſǆİ7²½'́") for _ in range(rng.randint(1, 9))) + "".join(rng.choice(P.Parts.MARKS + "'-é") for _ in range(rng.randint(0, 3)))
        space = rng.choice([" ", "\t\n", "\x0b", "\x0c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\x1c", "\x1f ", "\u200b", "\ufeff", "\u180e"])
        text = f"{part} {part.upper()}{space}a{part}{space}b"
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text), text


def test_a_word_with_marks_is_remembered_once_it_is_met_again(plain):
    from tokenizers import Tokenizer

    parts = P.Parts(Tokenizer.from_file(PATH))
    for _ in range(2):
        for part in ("zwölf,", "a-", "a-.", "don't", "don't.", "été...", "ÿ!"):
            assert np.frombuffer(parts[part], "<u4").tolist() == plain(part), part
        parts["once."]
        if "twice" not in parts:
            parts["twice."]
            assert "once" in parts and "once." not in parts and "twice." not in parts
    parts["twice."]
    assert "once." in parts and "twice." in parts


def test_splittable_is_read_from_the_file(tmp_path):
    import json

    assert P.splittable(PATH) and not P.splittable(P.tokenizer_file("byte_bpe_50k.json"))
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "word_bpe_49k.json").write_text(json.dumps(spec))
    assert not P.splittable(f"{tmp_path}/word_bpe_49k.json")


@pytest.mark.parametrize("few", [4_000_000, 0])
def test_pieces_round_trip(docs, plain, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "Delta."]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    d = docs([(i, t, "s") for i, t in enumerate(texts)])
    rows = P.pack(d, PATH, capacity=32).collect()
    ids, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r.id, r.piece)):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(ids.setdefault(r.id, [])) and r.length == len(own) <= 32 and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        ids[r.id] += own
    assert ids == {i: plain(t) + [P.END_ID] for i, t in enumerate(texts)}
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 32
        ends[seq] = at
    assert len(ends) <= -(-sum(map(len, ids.values())) // 32) * 1.05 + 1


def test_edges(ugly, empty):
    rows = P.pack(ugly, PATH, with_ids=False).collect()
    assert {(r.row_id, r.piece) for r in rows}.__len__() == len(rows) and len({r.row_id for r in rows}) == 10
    assert [r.length for r in rows if r.id == 2] == [1]
    assert max(r.piece for r in rows if r.id == 4) > 0
    assert P.pack(empty, PATH).count() == 0
