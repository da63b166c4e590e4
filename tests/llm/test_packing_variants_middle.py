"""Packing along a curve, spelling variants and fill-in-the-middle, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarterlode.llm import middle, packing, variants

# Packing


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(docs, rows, length=packing.LENGTH):
    """Every id of every document lies in one piece, and sequences have no gaps and no padding but in the last."""
    want = Counter((r.doc_id, tuple(whole_ids(r.text))) for r in docs)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in places:
        assert s * length + o == at and 0 < n and o + n <= length
        at += n
    assert at == sum(len(ids) * k for (_, ids), k in want.items())
    of = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        of.setdefault(r.doc_id, []).append(r)
    got = Counter()
    for doc_id, pieces in of.items():
        ids = ()
        for r in pieces:  # documents lie one behind the other, so those of one id do not mix
            assert r.start == len(ids)
            ids += tuple(r.ids)
            if len(ids) == r.doc_tokens:
                got[doc_id, ids] += 1
                ids = ()
        assert not ids
    assert got == want


def test_pieces_of_odd_table(odd, clashing, empty):
    rows = packing.pack(odd, packing.default_tokenizer(), ranks_file=packing.default_ranks()).collect()
    check_pieces(odd.collect(), rows)
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(clashing, packing.default_tokenizer(), ranks_file=packing.default_ranks()).collect()))
    assert packing.pack(empty, packing.default_tokenizer(), ranks_file=packing.default_ranks()).count() == 0


def test_short_sequences_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_PER_BUCKET", 300)
    rng = random.Random(3)
    texts = ["the same passage again and again", *(" ".join(rng.choice(("old", "new", "naïve", "x1", "\n", " ", "don't")) for _ in range(rng.randint(0, 90))) for _ in range(300))]
    rows = [(i if i % 7 else None, texts[0] if i % 3 == 0 else texts[i % len(texts)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(docs, packing.default_tokenizer(), ranks_file=packing.default_ranks(), length=64).collect()
    named = [r for r in docs.collect() if r.doc_id is not None]
    assert sum(r.length for r in got if r.doc_id is None) == sum(len(whole_ids(r.text)) for r in docs.collect() if r.doc_id is None)
    ends = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(ends)) and ends[0][0] == 0
    for r in named:
        mine = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [x for p in mine for x in p.ids] == whole_ids(r.text)
    whole = packing.sequences(packing.pack(docs, packing.default_tokenizer(), ranks_file=packing.default_ranks(), length=64), length=64).collect()
    assert all(len(s.ids) == 64 for s in whole if s.sequence_id < len(whole) - 1)
    last = max(whole, key=lambda s: s.sequence_id)
    assert len(last.ids) & (len(last.ids) - 1) == 0 and sum(last.lengths) > len(last.ids) // 2


def test_ids_equal_the_librarys():
    ids = packing.load(packing.default_tokenizer(), packing.default_ranks())
    texts = ["", " ", "  a", "a  b \n c\t d ", "it's  \x1c x", "<|endoftext|> a <|endoftext|>", "é 😀 　z\u0085 q", "x" * 200 + " " + "y" * 100, " lead", "a\n\n b\r\n  c", " " * 1_500_000 + "x", "ab" * 300_000]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \n\tab'sé1.　 ") for _ in range(60)) for _ in range(300)]
    assert ids.texts(texts) == ids.whole(texts)


@pytest.mark.parametrize(("dims", "bits"), [(2, 5), (3, 3), (4, 2)])
def test_hilbert_steps_to_a_neighbour(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_near_copies_are_packed_side_by_side(spark):
    rng = random.Random(9)
    themes = [["".join(rng.choice(variants.LOWER) for _ in range(6)) for _ in range(12)] for _ in range(20)]
    rows = [(i, " ".join(rng.choice(themes[i % 20]) for _ in range(120))) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_tokenizer(), ranks_file=packing.default_ranks()).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(a % 20 == b % 20 for a, b in itertools.pairwise(order))
    assert same > 50  # by chance about 9


# Spelling variants


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_and_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(5, 8))) for _ in range(120)]
    texts = []
    for i in range(900):
        words = []
        for _ in range(12):
            w = rng.choice(base[: 1 + int(rng.paretovariate(0.4)) % 120])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("abÿz") + w[at:], w[:at] + "q" + w[at + 1 :], w.upper()))
            words.append(w)
        texts.append((i if i % 11 else None, " ".join(words) if i % 50 else None))
    words = variants.vocabulary(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    want = brute_words(texts)
    assert {r.word: r.n for r in words.collect()} == want
    got = grouped(variants.group(words))
    assert got == brute_groups(want)
    assert sum(x[0] is not None for x in got.values()) > 30 and any(x[0] != x[1] for x in got.values() if x[0])


def test_variants_of_odd_table(odd, clashing, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_groups(brute_words(rows))
    assert grouped(variants.group(variants.vocabulary(odd))) == want == grouped(variants.group(variants.vocabulary(clashing)))
    assert variants.group(variants.vocabulary(empty)).count() == 0


def test_long_words_and_a_shared_reduced_word(spark):
    same = [c for c in variants.LOWER if variants.reduced(["a"])[0, 0] == variants.reduced([c])[0, 0]]
    long = "z" * 3000
    words = {long: 9, long[:-1]: 4, long[:1500] + "y" + long[1501:]: 3, "".join(same[:1] * 6): 50}
    words |= {"".join(p): 3 + i for i, p in enumerate(itertools.product(same[:2], repeat=6))}
    got = grouped(variants.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_groups(words)


def test_neighbours_are_all_reduced_words_one_edit_away():
    rng = random.Random(2)
    every = range(1, variants.SYMBOLS + 1)
    for length in (2, 5, 9):
        word = tuple(rng.choice(every) for _ in range(length))
        want = {word[:i] + word[i + 1 :] for i in range(length)} | {word[:i] + (s,) + word[i + 1 :] for i in range(length) for s in every} | {word[:i] + (s,) + word[i:] for i in range(length + 1) for s in every}
        keys = {int(variants.own_keys(np.array([w], np.uint32))[0]) for w in want}
        assert set(variants.neighbour_keys(np.array([word], np.uint32))[0].tolist()) == keys and len(keys) == len(want)


# Fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    unit = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(unit)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check_middle(docs, rows):
    key = lambda r: str(r)
    want = sorted(((r.doc_id, *brute_middle(r.doc_id, r.text), r.text or "") for r in docs), key=key)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode()) for r in rows), key=key)
    assert got == want


def test_middle_of_odd_table(odd, clashing, empty):
    check_middle(odd.collect(), middle.fill_in_middle(odd).collect())
    check_middle(odd.collect(), middle.fill_in_middle(clashing.withColumn("form", F.lit(1))).collect())
    assert middle.fill_in_middle(empty).count() == 0
    assert middle.fill_in_middle(odd).columns[: len(odd.columns)] == odd.columns


def test_middle_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(middle, "BATCH_BYTES", 500)
    rng = random.Random(6)
    parts = ["word", "<", "<S", ">", "<P", "P>", "<M>", "é", "😀", "\n", "\x00", " ", "ab", "7", " "]
    rows = [(i, "".join(rng.choice(parts if i % 3 else [p for p in parts if p != "<M>"]) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = middle.fill_in_middle(docs).collect()
    check_middle(docs.collect(), got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_units_are_code_points_or_runs_of_letters():
    assert middle.units(pa.array(["ab c\x00é1".encode(), b""], pa.binary())).to_pylist() == [[b"ab", b" ", b"c", b"\x00", "é".encode(), b"1", b""], [b""]]
