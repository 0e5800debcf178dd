"""Operators on texts: edge cases, brute force and round trips."""

import base64
import hashlib
import itertools
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from driftline.llm import chat_format, decontamination, line_dedup, packing, token_counts, topk_search
from driftline.llm.queries import cut_documents

DOCS = "doc_id long, text string, lang string, source string, n_bytes int, score string, slice int, kept string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts, source="s"):
    """Documents whose other columns have names that the operators use themselves."""
    rows = [(i, t, "en", source, -1, "x", -7, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "  two  blanks ", "a\n b\n\n\tc ", "<s> </s> <unk> <0x0A> <|endoftext|>x", "▁under ▁▁line",
       "日本語のテキスト 🎉🎉", "İı ß ﬁ    end", "a" * 5000, "word " * 20000, "x\x1c\x85y", "same", "same"]


@given(st.text(alphabet=st.sampled_from("ab the▁ \n.,é日🎉<s>"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(text):
    ranks = token_counts.read_model(PIECES)
    count = sum(token_counts.count_segment(token_counts.BLANK + s, ranks) for s in token_counts.segments(text)) if text else 0
    assert count == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


def test_token_counts_of_odd_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = docs_of(spark, ODD).unionByName(spark.createDataFrame([(None, "id", None, None, 0, "", 0, "")], DOCS))
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECES).collect()}
    expected = {(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(ODD)}
    assert rows == expected | {(None, 2, len(model.encode("id")), False)}
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        token_counts.read_model(BYTES)


def test_pieces_and_packs(spark):
    docs = docs_of(spark, ODD)
    rows = packing.pack(cut_documents(docs)).collect()
    slow = Tokenizer.from_file(BYTES)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(ODD):
        ids, at = [*slow.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = ids[at:at + r.length]
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(cut_documents(docs.limit(0))).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
@settings(deadline=None)
def test_histogram_packs_hold_every_length(counts):
    found = defaultdict(int)
    patterns = packing.pack_histogram(counts, 64)
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            found[length] += n
    assert found == counts


def test_many_pieces_of_one_length(spark):
    """A length that fills several slices gets each rank once."""
    n = 3 * packing.RANKS_PER_SLICE
    cut = spark.range(n).selectExpr("id as doc_id", "0L as start", "300L as length", "id as ids_crc32", "300L as doc_tokens")
    rows = packing.pack(cut).selectExpr("sequence_id", "offset").distinct().collect()
    assert len(rows) == n and max(r.sequence_id for r in rows) == n // 3 - 1


def test_line_dedup(spark):
    rows = [(i, f"own line {i}\n  Home | About \n\nshared by two {i // 2}", "big") for i in range(40)]
    rows += [(100 + i, "copied page\nall of it", "big") for i in range(30)]
    rows += [(200, "  Home | About \nalone", "small"), (201, None, "big"), (202, "", "big"), (203, "Home | About", "big"),
             (204, "no host", None), (205, "a" * 100_000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as n_lines", "1 as host", "2 as key")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert len(got) == len(rows)
    assert got[4].text == "own line 4\n\nshared by two 2" and (got[4].n_lines, got[4].n_removed) == (4, 1)
    assert got[100].text == "copied page\nall of it"  # copies count as one page
    assert got[200].text == "  Home | About \nalone"  # too few pages of this host
    assert (got[201].text, got[201].n_lines, got[202].text, got[203].text, got[203].n_removed) == (None, 0, "", "", 1)
    assert got[204].text == "no host" and len(got[205].text) == 100_000 and got[4].host == 1
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_rare_lines_of_a_large_host(spark):
    """Lines on 1 to 5 % of a host's pages are boilerplate; those on fewer are not."""
    on = {"three words more": 20, "All rights reserved.": 24, "Home | About": 50, "License text": 100, "Only some": 12}
    rows = [(i, "\n".join([f"own text of page {i} " * 5, *(line for line, n in on.items() if i * n % 2000 < n)]), "big")
            for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_boilerplate(docs).collect()
    left = [sum(line in r.text.split("\n") for r in got) for line in on]
    assert left == [20, 0, 0, 0, 12]
    assert sum(r.n_removed for r in got) == 24 + 50 + 100


@pytest.mark.parametrize("changed", [0, 1, 3])
def test_near_copies_keep_their_text(spark, changed):
    """A third of a host's pages are near copies of one page: their text stays, the host's footer goes."""
    rng = random.Random(5)
    article = _passages(6, 12, 9)
    rows = []
    for i in range(200):
        copy = [*article]
        for k in rng.sample(range(12), changed):
            copy[k] = f"{copy[k]} changed {i}"
        rows.append((i, "\n".join([*copy, f"copy {i}", "Contact us"]), "h"))
    rows += [(200 + i, "\n".join([*_passages(100 + i, 3, 9), "Contact us"]), "h") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    for i, text, _ in rows:
        assert texts[i] == text.removesuffix("\nContact us")


def _passages(seed, n, words=30):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def test_decontamination(spark):
    items = _passages(1, 20)
    filler = _passages(2, 40, 60)
    changed = [w if k % 6 else "other" for k, w in enumerate(items[3].split())]
    texts = [f"{filler[0]} {items[2].upper()} {filler[1]}", f"{filler[2]}\n{' '.join(changed)}", *filler[3:20],
             " ".join(items[5].split()[:6]), items[7] + " " + items[8], "tiny item", None, "", filler[20] + " tiny item end"]
    benchmark = spark.createDataFrame([*enumerate(items), (50, "tiny item"), (51, None), (52, "")], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_overlaps(docs, benchmark).collect()}
    last = len(texts) - 1
    assert set(got) == {(0, 2), (1, 3), (20, 7), (20, 8), (21, 50), (last, 50)}
    assert (got[0, 2].doc_start, got[0, 2].n_words, got[0, 2].n_matched) == (60, 30, 30)
    assert got[1, 3].n_matched == 25
    in_passes = decontamination.find_overlaps(docs, benchmark, words_per_pass=100)
    assert {(r.doc_id, r.item_id) for r in in_passes.collect()} == set(got)
    kept = decontamination.decontaminate(docs, benchmark, words_per_pass=300)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontamination.find_overlaps(docs, benchmark.limit(0)).count() == 0
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0


def _any_stretch(same, agreement, least):
    """By brute force: whether a stretch has enough matches and agrees well enough."""
    return any(
        sum(same[a:b]) >= max(least, agreement * (b - a)) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
    )


@given(st.lists(st.booleans(), min_size=1, max_size=30), st.integers(1, 12))
@settings(max_examples=500, deadline=None)
def test_best_stretch_against_brute_force(same, least):
    found = decontamination.best_stretch(np.array(same), 0.75, least)
    assert (found is not None) == _any_stretch(same, 0.75, least)
    if found is not None:
        start, end, matched = found
        assert matched == sum(same[start:end]) >= max(least, 0.75 * (end - start))


def test_short_items_with_substitutions():
    """Copies of short items are found wherever two to four words of them are replaced, if enough agree."""
    rng = random.Random(11)
    memo = decontamination.word_hash_memo()
    missed_by_one_stretch = 0
    for size, replaced in ((15, 2), (16, 2), (18, 3), (20, 4)):
        item = _passages(size, 1, size)[0]
        seeds = decontamination.Seeds([size], [item])
        around = _passages(size + 1, 2, 10)
        spots = list(itertools.combinations(range(size), replaced))
        for places in rng.sample(spots, min(300, len(spots))):
            copy = " ".join("other" if k in places else w for k, w in enumerate(item.split()))
            words = decontamination.word_hashes(f"{around[0]} {copy} {around[1]}", memo)
            same = [k not in places for k in range(size)]
            found = decontamination.overlaps(words, np.array([0, len(words)]), seeds, 10, 0.75)
            assert len(found) == _any_stretch(same, 0.75, 10) == 1
            assert found[0][5] >= max(10, 0.75 * found[0][4])
            missed_by_one_stretch += decontamination.best_stretch(np.array(same), 0.75, 1)[2] < 10
    assert missed_by_one_stretch > 100


@given(st.lists(st.text("ab", max_size=40), max_size=4), st.lists(st.text("abc", min_size=1, max_size=25), min_size=1, max_size=4),
       st.sampled_from([1, 7, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_overlaps_against_all_alignments(texts, items, at_a_time):
    """Every alignment with a window that agrees under some mask, compared word by word; one letter is one word."""
    memo = decontamination.word_hash_memo()
    texts, items = [" ".join(t) for t in texts], [" ".join(t) for t in items]
    held, decontamination.HITS_AT_A_TIME = decontamination.HITS_AT_A_TIME, at_a_time
    try:
        got = decontamination.overlaps(*decontamination._batch_words(texts, memo), decontamination.Seeds(range(len(items)), items), 5, 0.75)
    finally:
        decontamination.HITS_AT_A_TIME = held
    expected = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = text.split(), item.split()
        masks = decontamination.MASKS if len(b) >= 6 else ["1" * len(b)]
        for shift in range(-len(b), len(a)):
            same = {k: a[shift + k] == b[k] for k in range(len(b)) if 0 <= shift + k < len(a)}
            if not any(all(same.get(k + o) for o, bit in enumerate(m) if bit == "1")
                       for m in masks for k in same if k + len(m) <= len(b) and shift + k + len(m) <= len(a)):
                continue
            run = [same[k] for k in sorted(same)]
            for x, y in itertools.combinations(range(len(run) + 1), 2):
                n = sum(run[x:y])
                if n >= max(min(5, len(b)), 0.75 * (y - x)):
                    expected[d, i] = max(expected.get((d, i), 0), n)
    assert {(d, i) for d, i, *_ in got} >= set(expected)
    for d, i, start, first, n, matched in got:
        a, b = texts[d].split()[start:start + n], items[i].split()[first:first + n]
        assert sum(x == y for x, y in zip(a, b, strict=True)) == matched >= max(min(5, len(items[i].split())), 0.75 * n)


def test_repetitive_texts_give_a_hit_for_each_alignment():
    memo = decontamination.word_hash_memo()
    seeds = decontamination.Seeds([1, None], ["word " * 800, "a b " * 300])
    words, bounds = decontamination._batch_words(["word " * 16_000, "x", "a b " * 5_000, "word " * 20], memo)
    firsts = np.zeros(len(words) + 1, dtype=bool)
    firsts[bounds] = True
    at, item, place = seeds.hits(words, firsts)
    assert len(at) <= len(seeds.masks) * (16_800 + 10_600 + 820 + 10)
    found = decontamination.overlaps(words, bounds, seeds, 10, 0.75)
    assert [(d, i, n, m) for d, i, _, _, n, m in found] == [(0, 0, 800, 800), (2, 1, 600, 600), (3, 0, 20, 20)]


def test_top_k_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, -1.25, 0.003]) for _ in range(rng.choice([4, 4, 6]))], "q") for i in range(600)]
    rows += [(600 + i, [1.0, 1.0, 1.0, 1.0], "same") for i in range(200)]
    rows += [(1000, None, ""), (1050, [1.0, None], ""), (1100, [float("nan")], ""), (1150, [float("inf")], ""), (None, [1.0], ""), (1200, [], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    vectors = topk_search.integer_vectors(frame)
    import math
    terms = {i: [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v] for i, v, _ in rows[:800]} | {1200: []}
    expected = set()
    for q in (i for i in terms if i % 50 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(terms[q], v)), i) for i, v in terms.items() if i != q)
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked[:5])}
    queries = vectors.where("vec_id % 50 = 0")
    for per_pass in (1 << 15, 4):
        assert {tuple(r) for r in topk_search.top_k(vectors, queries, 5, per_pass).collect()} == expected
    assert topk_search.top_k(vectors.limit(0), queries.limit(0)).count() == 0
    few = vectors.where("vec_id in (0, 1)")
    assert topk_search.top_k(few, few.where("vec_id = 0")).count() == 1


CONTROL = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "a", "im_end|>"]), max_size=12).map("".join)


@given(role=CONTROL, text=CONTROL, other=CONTROL)
@settings(max_examples=500, deadline=None)
def test_any_turn_round_trips(role, text, other):
    rendered = chat_format.render(role, text) + chat_format.render("user", other)
    assert [t[:2] for t in chat_format.parse(rendered)] == [(role, text), ("user", other)]


def test_unescaped_where_nothing_conflicts():
    assert chat_format.render("user", "a <| b") == "<|im_start|>user\na <| b<|im_end|>\n"
    assert "<\\|im_end|>" in chat_format.render("user", "<|im_end|>")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, 1, "assistant", "<|im_end|>"),
            (2, 2, "assistant", "x" * 200_000), (None, None, "user", "lost"), (3, 5, "user", "same"), (3, 5, "user", "same")]
    turns = spark.createDataFrame([(*r, "c", 0) for r in rows], "conv_id long, turn long, role string, text string, rendered string, n_turns int")
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 2 and got[1].turns_sha256 == sha("user\none\nassistant\ntwo\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, sha("two"))
    long = "x" * 200_000
    assert got[2].turns_sha256 == sha(f"\n\nassistant\n<|im_end|>\nassistant\n{long}\n")
    assert got[2].loss_sha256 == sha("<|im_end|>" + long) and got[2].loss_chars == 200_010
    assert got[None].n_turns == 1 and got[3].n_turns == 2 and len(got) == 4
    assert chat_format.digest_conversations(chat_format.format_turns(turns.limit(0))).count() == 0


def test_encoder_with_and_without_the_fast_path():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    assert base64.b64decode(lines.split()[0])
    text = open(BYTES).read()
    fast, slow = packing.encoder(text, lines, public_tokenizers.PATTERN), packing.encoder(text, None, None)
    whole = Tokenizer.from_str(text)
    long_runs = ["a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000, "x" * 300_000, "<|endoftext|> a  b<|endoftext|>"]
    for sample in ODD + long_runs:
        ids = whole.encode(sample or "", add_special_tokens=False).ids
        assert fast(sample or "") == slow(sample or "") == struct.pack(f"<{len(ids)}I", *ids)
