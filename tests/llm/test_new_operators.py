"""Fingerprints, phrases and tokenizer alignment against brute force, and all operators on odd rows."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import alignment, byte_level, jaccard, minhash, packing, phrases, secrets
from tests.llm.test_operators import DOCS, ODD, WORDS, brute_components, documents, sets_of, spans_of, texts_with_copies


def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5], (None, "with no id", "en", "s", 1), (None, "with no id", "en", "s", 1), (None, None, None, None, None), (7, "another seven", "en", "t", 2)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("doc", "component", "n", "low", "block", "range", "id", "h", "phrase", "w1", "a", "groups")})


# ---- fingerprints


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.8, 1.0):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(2000 * share), 2000 - int(2000 * share), 2000 - int(2000 * share)))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        wanted = len(common) / (len(common) + len(a) + len(b))
        assert minhash.likeness(minhash.digits(minhash.signature(x)), minhash.digits(minhash.signature(y))) == pytest.approx(wanted, abs=0.16)
    factors, offsets = minhash.universal()
    few = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    assert minhash.signature(few).tolist() == [min((int(f) * (int(x) >> 32) + int(o)) % 2**32 for x in few) for f, o in zip(factors[:, 0], offsets[:, 0], strict=True)]
    assert not len(minhash.bands(few[:0]))


@pytest.mark.parametrize("partitions", [1, 4])
def test_edits_follow_the_order_of_ids(spark, partitions, monkeypatch):
    texts = [*texts_with_copies(3), *ODD]
    rows = {r["doc"]: r for r in minhash.fingerprint_edits(documents(spark, texts).repartition(partitions), words=3).collect()}
    assert len(rows) == len(texts)
    sets = list(sets_of(texts, 3))
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""  # descending ids; the last has the first as its next
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).digest()
        own, other, nxt = sets[i], next(sets_of([new], 3)), sets[i - 1]
        parts = [[bytes(f[k : k + 2]) for k in range(0, len(f), 2)] for f in (r["fingerprint"], r["edited_fingerprint"], rows[i - 1 if i else len(texts) - 1]["fingerprint"])]
        assert r["near_edited"] == np.mean([a == b for a, b in zip(parts[0], parts[1], strict=True)])
        assert r["near_next"] == np.mean([a == b for a, b in zip(parts[0], parts[2], strict=True)])
        assert r["near_edited"] == pytest.approx(len(own & other) / len(own | other) if own | other else 1, abs=0.25)
        assert r["near_next"] == pytest.approx(len(own & nxt) / len(own | nxt) if own | nxt else 1, abs=0.25)
    assert rows[texts.index("same text here")]["fingerprint"] == rows[texts.index("same text here") + 1]["fingerprint"]


def test_edited_texts_hash_words_at_their_cuts_only(monkeypatch):
    texts = ["", " ", "x", "é", "ab", "a b", " a", "a ", "one two", "One  two\tthree four", "x" * 9, "\n a bb ccc dddd\x0b", "é" * 5 + " \U0001f600 z", " ".join(WORDS[:41])]
    shingler = jaccard.Shingler(3)
    marked = [minhash.Marked(t, shingler) for t in texts]
    hashed, hashes = [], jaccard.Shingler.hashes
    monkeypatch.setattr(jaccard.Shingler, "hashes", lambda self, words: hashed.append(len(words)) or hashes(self, words))
    for own in marked:
        for after in marked:
            new = minhash.edited(own.text, after.text)
            assert minhash.edited_hashes(own, after, new, shingler).tolist() == hashes(shingler, jaccard.words_of(new)).tolist(), (own.text, after.text)
    assert max(hashed) <= 2


def test_bands_find_near_duplicates(spark):
    texts = [*texts_with_copies(4), *ODD]
    sets = dict(enumerate(sets_of(texts, 3)))
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(documents(spark, texts), words=3, num=80, den=100).collect()
    assert {r["doc"]: r["component"] for r in rows} == brute_components(links, sets)
    assert {r["doc"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}


def test_bands_come_from_fingerprints_and_lone_rows_are_not_joined(spark, monkeypatch):
    rng = np.random.default_rng(8)
    own = [" ".join(rng.choice(WORDS, 60)) for _ in range(300)]
    texts = [*own, *own[:12], *[" ".join([*t.split(), "end"]) for t in own[12:20]], "", None]
    docs = documents(spark, texts)
    made = minhash.fingerprint_edits(docs, words=3)
    assert not {"sigs", "heads"} & set(made.columns)  # what is written and read again holds each band once, in the fingerprint
    narrow = {r["doc"]: r for r in minhash.shared_bands(minhash.materialize(made.coalesce(1))).collect()}
    sets = [np.unique(jaccard.Shingler(3)(t)) for t in texts]
    bands = [set(minhash.bands(s).view(np.int64).tolist()) for s in sets]
    met = Counter(b for i, found in enumerate(bands) for b in found if i < 300 or 312 <= i < 320)
    for i, found in enumerate(bands):
        sigs = narrow[i]["sigs"]
        assert sigs is None if not found else sigs is None or {b for b in found if met[b] > 1} <= set(sigs) <= found
    assert sum(len(r["sigs"] or ()) for r in narrow.values()) < 0.2 * 32 * len(texts)
    joined, join = [], minhash.join_hot
    monkeypatch.setattr(minhash, "join_hot", lambda rows, *a, **b: joined.append(rows.count()) or join(rows, *a, **b))
    wanted = {(r["doc"], r["component"], r["n_shingles"]) for r in minhash.fingerprint_documents(docs, words=3).collect()}
    monkeypatch.setattr(minhash, "FEW", -1, raising=False)
    rows = minhash.fingerprint_documents(docs, words=3).collect()
    assert {(r["doc"], r["component"], r["n_shingles"]) for r in rows} == wanted and len(rows) == len(texts)
    assert {r["doc"]: r["component"] for r in rows} == {i: i - 300 if 300 <= i < 320 else i for i in range(len(texts))}
    assert 32 <= joined[-1] < 40  # 24 rows with a copy and 8 that are linked to a smaller one


def test_fingerprints_of_odd_rows(spark):
    docs = odd_rows(spark)
    rows = minhash.fingerprint_documents(docs).collect()
    assert len(rows) == docs.count() and sum(r["doc"] is None for r in rows) == 3
    same = [r for r in rows if r["doc"] in (5, 6)]
    assert len(same) == 4 and len({r["fingerprint"] for r in same}) == 1 and {r["component"] for r in same} == {5}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert minhash.fingerprint_documents(docs.where("false")).count() == 0
    alone = minhash.fingerprint_documents(docs.where("text = 'another seven'")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"another" + b"another seven"[:6]).hexdigest()


# ---- phrases


def brute_phrases(rows, least, share, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in found.items()):
                continue
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(5)
    words = ["the", "of", "É", "Über", "x" * 300, *WORDS[:12]]
    texts = []
    for _ in range(60):
        drawn = list(rng.choice(words, p=[0.3, 0.2, *[0.5 / 15] * 15], size=int(rng.integers(1, 80))))
        drawn[int(rng.integers(len(drawn)))] = "New York City Hall Park"
        texts.append("".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " - "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in drawn))
    return [(t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts)] + [(t, "en") for t in ODD]


@pytest.mark.parametrize(("least", "share", "top"), [(5, 100, 2000), (3, 60, 10)])
def test_phrases_against_brute_force(spark, least, share, top):
    rows = phrase_rows()
    docs = documents(spark, [t for t, _ in rows], lang=[x for _, x in rows])
    found = phrases.collocations(docs.repartition(3), least=least, share=share, top=top).collect()
    assert sorted(map(tuple, found)) == brute_phrases(rows, least, share, top)


def test_phrases_with_hot_leading_words(spark, monkeypatch):
    """Partitions, kept words and kept keys so small that all are cut, and routes dealt to several tasks."""
    for name, n in (("PARTITION", 40), ("KEPT_KEYS", 64), ("IN_ROW", 9)):
        monkeypatch.setattr(phrases, name, n)
    rows = phrase_rows()
    docs = documents(spark, [t for t, _ in rows], lang=["en"] * len(rows))
    found = phrases.collocations(docs.repartition(3), least=4).collect()
    assert sorted(map(tuple, found)) == brute_phrases([(t, "en") for t, _ in rows], 4, 100, 2000)


def test_three_way_quicksort():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 4, (3000, 5)).astype(np.int64)
    words[rng.random(3000) < 0.2, 4] = 0
    weights = rng.integers(1, 5, 3000)
    want = Counter()
    for w, n in zip(words.tolist(), weights.tolist(), strict=True):
        for k in (3, 4, 5):
            if w[k - 1]:
                want[tuple(w[:k])] += n
    for least in (1, 60):
        found = {tuple(words[at, :depth].tolist()): size for at, depth, size in phrases.equal_parts(list(words.T), weights, least)}
        assert found == {w: n for w, n in want.items() if n >= least}


def test_scores_are_exact(spark):
    big = 10**15
    rows = [(big + 7, 10**16, big + 8, big + 9), (100, 3 * 10**9, 100, 100), (7, 10, 7, 7), (2**40, 2**41 + 1, 2**41 - 1, 2**40)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_phrases_of_odd_rows(spark):
    found = phrases.collocations(odd_rows(spark), least=2).collect()
    assert {r["phrase"] for r in found if r["lang"] == "en"} >= {"same text here", "with no id"} and found
    assert phrases.collocations(odd_rows(spark).where("false")).count() == 0


# ---- tokenizer alignment


def spelled_tokens(text):
    """(ids and bytes of A, of B) by the contract's own tokenizers."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    code = a.encode(" " + text, add_special_tokens=False)
    of_b = [b.id_to_piece(i) for i in b.encode(text)]
    bytes_b = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in of_b]
    return [(i, bytes(names[c] for c in t)) for i, t in zip(code.ids, code.tokens, strict=True)], list(zip(b.encode(text), bytes_b, strict=True))


def brute_alignment(texts):
    rows, counts = [], Counter()
    for text in texts:
        a, b = spelled_tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b))
        links = [(a[i][0], b[j][0]) for i, e in enumerate(ends_a) for j in [int(np.searchsorted(ends_b, e))] if ends_b[j] == e]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(str(k) for k, _ in a[i:x]) + "|" + ",".join(str(k) for k, _ in b[j:y]))
            i, j = x, y
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


ALIGNED = ["Hello <|endoftext|> world </s> <s>", "café naïve \U0001f600\U0001f601", "中文 日本語", "  two  spaces \n\tand tabs\r\n", "▁ lower", "a\0b", "ﬁ Å  x", "don't it's"]


def test_alignment_against_brute_force(spark, monkeypatch):
    given = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 3000 limit 60").fetchall()]
    texts = [*given, *ALIGNED, *[t for t in ODD if len(t or "") < 1000], *given[:3]]
    want = brute_alignment(texts)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for rows in (4096, 7):  # one block a task, and many
        monkeypatch.setattr(alignment, "BLOCK_ROWS", rows)
        got = {r["doc"]: tuple(r[c] for c in columns) for r in alignment.align_tokenizers(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    digests = {r["doc"]: r["groups"] for r in alignment.align_tokenizers(documents(spark, texts), digest=True).collect()}
    assert [digests[i] for i in range(len(texts))] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_alignment_of_odd_rows(spark):
    docs = odd_rows(spark)
    rows = alignment.align_tokenizers(docs).collect()
    assert len(rows) == docs.count() and sum(r["doc"] is None for r in rows) == 3
    for r in rows:
        assert r["n_links"] == r["n_groups"] >= r["n_best"] and (r["n_a"] > 0) == (r["groups"] != "")
    assert len({str(r) for r in rows if r["doc"] == 5}) == 1 and sum(r["doc"] == 5 for r in rows) == 3
    assert alignment.align_tokenizers(docs.where("false")).count() == 0
    only_empty = alignment.align_tokenizers(docs.where("text is null")).collect()
    assert only_empty and all(r["n_a"] == r["count_sum"] == 0 and r["groups"] == "" for r in only_empty)


# ---- very long texts and odd letters in earlier operators


@pytest.mark.parametrize("blank", [" ", "\t", " ", "\n ", "　 "])
def test_ids_of_very_long_blanks_equal_those_of_tokenizers(blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = blank * (3_000_000 // len(blank))
    for text in (run, f"a{run}b", f"{run} x <|endoftext|>{blank * 60_000}.", f"'s{run}'s"):
        assert byte_level.token_ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_of_long_blanks_repeated_rows_and_null_ids(spark):
    docs = odd_rows(spark).unionByName(spark.createDataFrame([(90, " " * 1_200_000, "en", "s", 1)], DOCS), allowMissingColumns=True)
    rows = packing.pack(docs).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert sum(r["length"] for r in rows if r["doc_id"] == 90) == 1_200_001
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert sum(r["doc_id"] is None and r["start"] == 0 for r in rows) == 3 and sum(r["doc_id"] == 5 and r["start"] == 0 for r in rows) == 3


def test_keywords_of_secrets_are_ascii():
    for text in ("ſecret = abcdefgh", "toKen=abcdefgh", "SECRET = abcdefgh toKen: abcdefgh"):
        found = secrets.find(text, secrets.BASE)
        assert ",".join(f"assign:{start}:{end}" for _, start, end, _ in found) == spans_of(text)
    assert not secrets.find("ſecret = abcdefgh") and len(secrets.find("SECRET = abcdefgh toKen: abcdefgh")) == 2


def test_signed_tokens_equal_the_pattern_and_take_linear_time():
    pattern = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = np.random.default_rng(7)
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "abcdefgh", ".", "x", " ", "12345678", "..", "eyJeyJ"], p=[0.15, 0.3, 0.25, 0.1, 0.03, 0.12, 0.02, 0.03], size=int(rng.integers(1, 40))))
        assert list(secrets.signed_tokens(text)) == [(m.start(), m.end(), m[0]) for m in pattern.finditer(text)], text
    began = time.monotonic()
    for unit in ("eyJ", "eyJabcdefgh.", "AKIA", "token:", "-----BEGIN PRIVATE KEY-----", "ghp_.", "eyJ."):
        secrets.find(unit * (3_000_000 // len(unit)))
    assert time.monotonic() - began < 60


def test_secrets_of_repeated_rows_and_null_ids(spark):
    docs = odd_rows(spark).unionByName(spark.createDataFrame([(None, "token: abcdefgh", None, None, None)] * 2, DOCS), allowMissingColumns=True)
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == docs.count() and sorted(r["n_assign"] for r in rows if r["doc"] is None) == [0, 0, 0, 1, 1]


def test_bands_and_segments_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bands = {r["doc"]: r["component"] for r in minhash.near_duplicates(docs).collect()}
    assert bands == {r["doc"]: r["component"] for r in jaccard.jaccard_join(docs).collect()}
