"""Alignment of tokenizers, language profiles and collocations against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest

from orrery.llm import collocations, language_id, token_align
from orrery.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, block string, pairs int"  # with names that operators use themselves
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "xx", "x", 1) for i, t in enumerate(texts)], DOCS)


def edge_texts():
    return [None, "", " \n\t ", "one", "one", LONG, "naïve Ünïcode ▁   x y 🙂", "a\x00b", "\n\n\n", " ", "a ", "  a  b\n  c \t d　 e", "x" * 20_000, "<|endoftext|> <s> </s> <unk>", "été à  la  plage ", "日本語 の テキスト", "\u0085 a   b"]


# --- alignment of tokenizers ---


def brute_alignment(texts):
    """Token by token, with whole texts through both libraries."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    signs = token_align.byte_signs()
    rows, held = [], Counter()
    for text in texts:
        empty = {"a": [], "b": [], "groups": [], "links": []}
        if not text:
            rows.append(empty)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            rows.append(empty)
            continue
        i = j = ea = eb = 0
        groups, links, own = [], [], [[], []]
        while i < len(ia) or j < len(ib):
            links.append((i, j))
            end_a, end_b = ea + len(ta[i]), eb + len(tb[j])
            if end_a <= end_b:
                own[0].append(ia[i])
                ea, i = end_a, i + 1
            if end_b <= end_a:
                own[1].append(ib[j])
                eb, j = end_b, j + 1
            if ea == eb:
                groups.append(own)
                own = [[], []]
        held.update({(ia[x], ib[y]) for x, y in links})
        rows.append({"a": ia, "b": ib, "groups": groups, "links": links})
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for r in rows:
        pairs = [(r["a"][x], r["b"][y]) for x, y in r["links"]]
        r["best"], r["sum"] = sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs)
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in r["groups"])
        r["digest"] = hashlib.sha256(said.encode()).hexdigest() if said else ""
    return rows, held


def odd_texts():
    rng = random.Random(3)
    signs = [" ", " ", "  ", "\n", "\t", " ", " ", "the", "ing", "Straße", "é", "12", "x9", "🙂", "'s", "'ll", ".", ",,", "日", "<s>", "\r\n", "\u0085", "–"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def check_alignment(spark, docs, texts):
    want, held = brute_alignment(texts)
    got = {r.doc_id: r for r in token_align.alignment_report(docs).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == tuple(len(w[k]) for k in ("a", "b", "groups", "links")), texts[i]
        assert (r.n_best, r.count_sum, r.groups_sha256) == (w["best"], w["sum"], w["digest"])
    return want, held


@pytest.mark.parametrize("rows", [token_align.BLOCK_ROWS, 7])
def test_alignment_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(token_align, "PAIRS_A_ROW", 5)  # in this process: what is read from blocks is the same
    texts = edge_texts() + odd_texts() + ["same text"] * 5
    docs = docs_of(spark, texts).repartition(3)
    token_align.BLOCK_ROWS, before = rows, token_align.BLOCK_ROWS
    try:
        want, held = check_alignment(spark, docs, texts)
    finally:
        token_align.BLOCK_ROWS = before
    whole = {r.doc.doc_id: r for r in token_align.align(docs).collect()}
    for i, w in enumerate(want):
        assert (whole[i].a_ids, whole[i].b_ids) == (w["a"], w["b"])
        assert [tuple(x) for x in whole[i].groups] == [tuple(map(len, g)) for g in w["groups"]] and sorted(map(tuple, whole[i].links)) == w["links"]
    pairs = {(r.a, r.b): (r.n, r.best) for r in token_align.pair_counts(docs).collect()}
    assert {p: n for p, (n, _) in pairs.items()} == held
    assert all(best == (n == max(m for (x, _), (m, _) in pairs.items() if x == a)) for (a, _), (n, best) in list(pairs.items())[:200])


def test_alignment_of_a_task_that_forgets():
    """Parts that were dropped and come again give the same."""
    import pyarrow as pa

    from orrery.llm.sentencepiece_codec import read_model

    with open(token_align.default_a(), encoding="utf-8") as f:
        aligner = token_align.Aligner(f.read(), read_model())
    texts = pa.array(odd_texts())
    first = aligner.block(texts)
    aligner.size = token_align.KNOWN_BYTES + 1
    again = aligner.block(texts)
    assert first[0][4] == again[0][4] and first[1].tolist() == again[1].tolist() and first[2].equals(again[2])
    aligner.by_part = False
    aligner.size = token_align.KNOWN_BYTES + 1
    whole = aligner.block(texts)  # as with tokenizers of another kind
    assert first[0][4] == whole[0][4] and first[2].equals(whole[2]) and first[3].equals(whole[3])


def test_ranges_with_gaps_are_coalesced():
    """Ranges need not tile the text: A and B may leave gaps."""
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = [np.sort(rng.choice(60, 2 * rng.integers(1, 8), replace=False)) for _ in range(2)]
        (a0, a1), (b0, b1) = ((c[::2], c[1::2]) for c in cuts)
        x, y = token_align.overlaps(a0, a1, b0, b1)
        want = [(i, j) for i in range(len(a0)) for j in range(len(b0)) if a0[i] < b1[j] and b0[j] < a1[i]]
        assert list(zip(x.tolist(), y.tolist())) == want
        group = token_align.coalesce(np.concatenate([a0, b0]), np.concatenate([a1, b1]))
        ends = list(zip(np.concatenate([a0, b0]), np.concatenate([a1, b1]), group))
        for p in ends:
            for q in ends:
                if p[0] < q[1] and q[0] < p[1]:
                    assert p[2] == q[2]
        assert len(set(group.tolist())) == 1 + sum(all(not (s < t < e) for s, e, _ in ends) for t in {s for s, _, _ in ends} - {min(s for s, _, _ in ends)})


def test_alignment_edges(spark):
    docs = docs_of(spark, ["a b", "a b", None])
    assert token_align.alignment_report(docs.where("false")).count() == 0
    named = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "block")
    rows = token_align.alignment_report(named).collect()
    assert len(rows) == 3 and all(r.doc_id is None for r in rows) and sorted(r.n_a for r in rows) == [0, 2, 2]
    assert {r.count_sum for r in rows} == {0, 4}


# --- languages ---


def brute_grams(text):
    """N-grams by signs, one after another."""
    import unicodedata

    found, real = Counter(), False
    kinds = [unicodedata.category(c)[0] for c in text or ""]
    shown = [" ", *(" " if k not in "LM" else c.lower() if len(c.lower()) == 1 else c for c, k in zip(text or "", kinds)), " "]
    for i in range(1, len(shown) - 1):
        if kinds[i - 1] in "LM":
            real |= kinds[i - 1] == "L"
            found[shown[i]] += 1
            found[shown[i - 1] + shown[i]] += 1
            found[shown[i - 1] + shown[i] + shown[i + 1]] += 1
            if shown[i + 1] == " ":
                found[shown[i] + " "] += 1
    return found if real else Counter()


def brute_code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


def brute_ranks(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], brute_code(g)))[:most]


def brute_language(text, profiles, most):
    own = brute_ranks(brute_grams(text), most)
    if not own or not profiles:
        return "und", 0.0
    far = [sum(abs(k - p.index(g)) if g in p else most for k, g in enumerate(own)) for p in profiles.values()]
    best = far.index(min(far))
    rest = min([d for k, d in enumerate(far) if k != best], default=most * len(own))
    return list(profiles)[best], rest / (rest + far[best]) if rest else 0.5


def language_rows():
    rng = random.Random(5)
    syllables = {"aa": ["lo", "mi", "tan", "re"], "bb": ["sch", "ung", "ei", "ck"], "cc": ["日", "本", "語", "の"], None: ["x"]}
    rows = [(i, "".join(rng.choice([*own, *own, " ", "É", "1", "é"]) for _ in range(rng.randrange(0, 60))), lang) for i, (lang, own) in enumerate(list(syllables.items()) * 40)]
    return rows + [(1000 + i, t, "aa") for i, t in enumerate(edge_texts())] + [(5, "lo mi", "bb"), (None, "lo", "aa"), (2000, None, None), (2001, "12 \u0301 ,", "bb"), (2002, "İstanbul lo", "aa")]


def test_languages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PROFILE", 25)
    monkeypatch.setattr(language_id, "COUNT_LETTERS", 1_000)  # long texts in parts
    monkeypatch.setattr(language_id, "HELD", 30)  # tasks hand on several times
    rows = language_rows()
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, score string").repartition(3)
    known = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] is not None]
    sizes = Counter(r[2] for r in known)
    profiles = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        profiles[lang] = brute_ranks(sum((brute_grams(t) for _, t, own in known if own == lang), Counter()), 25)
    model = language_id.fit(docs.where("crc32(CAST(doc_id AS STRING)) % 4 <> 2"), most=25)
    assert model.langs == list(profiles)
    want = Counter()
    for i, t, _ in rows:
        lang, score = brute_language(t, profiles, 25)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, lang, round(score, 9)] += 1
    told = language_id.identify(docs, model, carry=["doc_id"])
    got = Counter((r.doc.doc_id, r.doc.doc_id is not None and zlib.crc32(str(r.doc.doc_id).encode()) % 4 == 2, r.lang_pred, round(r.score, 9)) for r in told.collect())
    assert got == want


def test_languages_of_nothing_and_of_one(spark):
    docs = docs_of(spark, ["lo mi", None, "12"], ["aa", "aa", "bb"])
    assert language_id.languages(docs.where("false")).count() == 0
    none = language_id.languages(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null or true").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = {r.doc_id: r for r in language_id.languages(docs).collect()}
    assert one[1].lang_pred == one[2].lang_pred == "und" and one[0].lang_pred == "aa" and 0 <= one[0].score <= 1
    assert [one[i].held_out for i in range(3)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(3)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_languages_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op12_language"](spark, SF).collect() if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


# --- collocations ---


def brute_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return counts, total


def brute_collocations(rows, least, percent, top):
    counts, total = brute_counts(rows)
    candidates = {p: n for p, n in counts.items() if len(p) > 2 and n >= least}
    found = []
    for (lang, *w), a in candidates.items():
        inside = any(q[0] == lang and len(q) > len(w) + 1 and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w))) and 100 * n >= percent * a for q, n in candidates.items())
        if not inside:
            cuts = [(2_000_000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def collocation_rows():
    rng = random.Random(11)
    words = ["The", "the", "a", "of", "Straße", "ÄÖ", "x", "\u00a0y", "日本", "rare1", "rare2"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";", "!?", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(30))) for _ in range(120)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", t) for t in edge_texts()]
    return rows + [("de", "one long passage of words that comes again and again")] * 9 + [("fr", "la la la la la la")] * 3 + [("es", "..,;")]


@pytest.mark.parametrize("block_bytes", [collocations.BLOCK_BYTES, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block_bytes)
    rows = collocation_rows()
    docs = spark.createDataFrame([(t, lang, "x", 1) for lang, t in rows], "text string, lang string, block string, n int").repartition(3)
    for percent, top in ((80, 2_000), (100, 5)):
        got = [tuple(r) for r in collocations.collocations(docs, least=4, percent=percent, top=top).collect()]
        assert sorted(got) == sorted(brute_collocations(rows, 4, percent, top))
    counts, _ = brute_counts(rows)
    got = {(r.lang, *r.phrase.split(" ")): r.n for r in collocations.phrase_counts(docs, least=4).collect()}
    assert got == {p: n for p, n in counts.items() if n >= 4}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that takes nearly every pair for a frequent one leaves all counts as they are."""
    rows = collocation_rows()
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(2)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    got = [tuple(r) for r in collocations.collocations(docs, least=3).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, 3, 80, 2_000))


def test_paths_are_compacted_and_keep_every_edge():
    import numpy as np

    rng = np.random.default_rng(2)
    for size, words in ((0, 3), (3, 3), (200, 2), (400, 6), (900, 40), (300, 300)):
        stream = np.where(rng.random(size) < 0.05, -1, rng.integers(0, words, size)).astype(np.int32)
        if size == 300:
            stream[100:160] = stream[200:260]  # a passage that comes again
        runs = [r for r in "".join(" " if w < 0 else chr(w + 200) for w in stream).split(" ") if r]
        want = Counter(r[i : i + 4] for r in runs for i in range(len(r) - 3))
        ends = Counter(r[-k:] for r in runs for k in (1, 2, 3) if len(r) >= k)
        lengths, path, n = collocations.paths_of(stream)
        got, last, at = Counter(), Counter(), 0
        for length, weight in zip(lengths, n):
            said = "".join(chr(w + 200) for w in path[at : at + length])
            at += length
            if length > 3:
                got.update({said[i : i + 4]: weight for i in range(length - 3)})
            else:
                last[said] += weight
        assert got == want and last == ends
        if size == 300:
            assert lengths.max() >= 40  # paths, not single edges


def test_a_ring_without_ends_is_kept():
    import numpy as np

    edges = np.array([[0, 1, 2, 0], [1, 2, 0, 1], [2, 0, 1, 2], [7, 7, 7, 8]])
    lengths, words, weights = collocations.compact(edges, np.array([5, 5, 5, 2]))
    assert sorted(lengths.tolist()) == [4, 4, 4, 4] and sorted(weights.tolist()) == [2, 5, 5, 5] and sorted(map(tuple, words.reshape(-1, 4).tolist())) == sorted(map(tuple, edges.tolist()))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_001
    two = collocations._key([collocations.F.lit(1), collocations.F.lit(2)])
    p = spark.range(1).select(two[0]).first()[0]
    counts = spark.createDataFrame([(2, p, 0, big), (1, 1, 0, big), (1, 2, 0, big + 1)], "k int, p bigint, q bigint, n bigint")
    row = collocations.scored(counts, 80).first()
    assert row.score == 2_000_000 * big // (2 * big + 1) and (row.a, row.l, row.r) == (big, big, big + 1)


def test_collocations_of_nothing(spark):
    docs = docs_of(spark, ["a b", None, ""])
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.where("false")).count() == 0
