"""Each operator against a plain version of its contract, on small tables with nulls, empty texts, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from termscan.llm import components, decontaminate, exact_dedup, html_extract, jaccard_join, line_dedup, piece_tokenizer, suffix_dedup, token_counts, token_files, toxicity
from termscan.llm._common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, same long, rep string, score double, gid long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", None, 7, "r", 0.5, 1) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 40, 90, 200, 400)]
    found = [(i, t) for i, t in enumerate(base)]
    found += [(10, base[2]), (11, base[2].replace(" ", "\t\n")), (12, base[3] + " more words here"), (13, base[3][:-30]), (14, prose(rng, 60) + " " + base[4][100:700] + " " + prose(rng, 30))]
    found += [(20, None), (21, ""), (22, " \n "), (23, "a"), (24, "A"), (25, base[1]), (25, base[1]), (26, "x " * 400), (27, "x " * 400), (None, base[0]), (None, None), (30, "\n".join([base[0], base[1], prose(rng, 9)])), (31, "\n".join([prose(rng, 9), base[0], base[1]]))]
    return found


def test_empty_tables(spark):
    docs, bench = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.exact_groups(docs), piece_tokenizer.piece_tokens(docs, P.path("piece_bpe_32k.model")), token_files.token_files(docs, P.path("word_bpe_49k.json")), suffix_dedup.without_repeats(docs), token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN), toxicity.toxicity(docs, toxicity.learn(docs, labels)), decontaminate.contamination(docs, bench), jaccard_join.near_duplicates(docs), line_dedup.line_report(docs), html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.collect() == []


@pytest.mark.parametrize("block", [7, 16384])
def test_exact_dedup(spark, rows, block):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    expected = collections.Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = exact_dedup.exact_groups(table(spark, rows), block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collections.Counter(map(tuple, got.collect())) == expected


STRANGE = ["a", "b", " ", "  ", "   ", "\n", "\t", "1", "23", "é", "É", "ß", "İ", "<s>", "<0x0A>", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "🙂", " ", "!", "hello", " the", "\r\n", "▁", "ban", "\0", "'s", "é", "a.", "b,", "..", "ꙮ", "aaaa"]


def strange(n=400):
    rng = random.Random(9)
    return ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_sentencepiece(spark, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    data = [*rows, *((100 + i, t) for i, t in enumerate(strange()))]
    expected = collections.Counter()
    for i, t in data:
        ids = lib.encode(t or "")
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, piece_tokenizer.piece_tokens(table(spark, data), P.path("piece_bpe_32k.model")).collect())) == expected
    model, rng = piece_tokenizer.piece_model(P.path("piece_bpe_32k.model")), random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(300) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == lib.decode(ids)
    for n in [*range(1, 40), 47, 48, 49, 63, 64, 65, 66, 80, 95, 97, 128, 1000, 1023]:
        for text in (" " * n, " " * n + "abc  d", "x" + " " * n + "1", "\n" + " " * n + "\n", "▁" * n + " x"):
            assert model.encode([text])[0].tolist() == lib.encode(text)
    began = time.monotonic()
    long = " " * 1_000_000 + "end " * 10 + " " * 999_999
    assert model.encode([long])[0].tolist() == lib.encode(long) and time.monotonic() - began < 3
    both = piece_tokenizer.decoded(piece_tokenizer.encoded(table(spark, rows), P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model"))
    assert collections.Counter(r.text for r in both.collect()) == collections.Counter(t or "" for _, t in rows)


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    data = [*rows, *((100 + i, t) for i, t in enumerate(strange()))]
    expected, at = [], 0
    for i, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_files(table(spark, data), P.path("word_bpe_49k.json")).collect()), key=lambda r: r[1]) == expected
    token_files.dump(token_files.write_images(table(spark, rows), P.path("word_bpe_49k.json"), Scratch(spark, "t")), str(tmp_path))
    assert sum(token_files.TokenFile(f.read_bytes()).n_tokens for f in tmp_path.glob("*.dac")) > 0


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_direct_access(bits):
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**20, 1500)]).astype(np.uint32)
    file = token_files.TokenFile(token_files.pack([1, None], np.array([0, 3000, 4500]), ids, bits))
    assert file.doc_ids == [1, None] and (file.tokens(0, 4500) == ids).all() and (file.document(1) == ids[3000:]).all()
    assert all(file.token(i) == ids[i] for i in range(0, 4500, 13)) and (file.tokens(777, 3333) == ids[777:3333]).all()


def test_suffix_dedup(spark, rows):
    expected = []
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sum(e[2] for e in expected) > 0
    for more in ({}, {"batches": 3}, {"together": 1}):
        got = suffix_dedup.without_repeats(table(spark, rows), keep=False, **more).drop("kept")
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(expected)


def test_suffix_family_grows_by_batches(spark, rows, tmp_path):
    keyed = table(spark, rows).selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) same")
    entries = Scratch(spark, "entries").put(suffix_dedup.suffixes(keyed, 200), "all")
    family, sizes = suffix_dedup.SuffixFamily(Scratch(spark, "family")), []
    part = lambda k: entries.where(f"pmod(hash(doc_id, same), 7) = {k}")
    for k in range(7):
        if k == 5:  # another run goes on with what was kept
            family.save(str(tmp_path / "kept"))
            before, family = family, suffix_dedup.SuffixFamily(Scratch(spark, "family"))
            family.load(str(tmp_path / "kept"))
            family.whole, family.grams, family.turn = before.whole, before.grams, before.turn
        family.add(part(k))
        sizes.append([size for size, *_ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    counted = collections.Counter(tuple(r) for r in entries.select("gram", "c1", "c2").collect())
    got = collections.Counter()
    for _, level, _ in family.levels:
        got.update({(r.gram, r.c1, r.c2): r.n for r in level.collect()})
    assert got == counted
    whole, grams = family.matches()
    assert {tuple(r) for r in whole.collect()} == {k for k, n in counted.items() if n > 1}
    contexts = collections.Counter(g for g, *_ in counted)
    assert {r.gram for r in grams.collect()} == {g for g, n in contexts.items() if n > 1}


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = [*rows, *((100 + i, t) for i, t in enumerate(strange()))]
    got = collections.Counter(map(tuple, token_counts.token_counts(table(spark, data), P.path("byte_bpe_50k.json"), P.PATTERN).collect()))
    expected = collections.Counter()
    for i, t in data:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 512] += 1
    assert got == expected


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(rng, 30) + (" you stupid 1dіot " if bad and i % 2 else " IDIOT! " if bad else " fine idiotype " if i % 7 == 0 else "") + prose(rng, 30)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None)]
    docs = table(spark, [*rows, (None, "idiot"), (900, None), (901, "")])
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    assert len(got) == 403 and got[900].score == got[901].score == 0.0
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert toxicity.accepted(docs, lexicon).columns == docs.columns


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" trash": 3.0}, {"trash can"}, 1.0)
    assert lexicon.score("put it in the trash can") == 0 and lexicon.score("you tr4sh") > 0


def test_all_exception_phrases_are_kept(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + (" idiot " if i % 5 == 0 else " my idiot board " if i < 16 else " ") + prose(rng, 30)) for i in range(400)]
    lexicon = toxicity.learn(table(spark, rows), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int"))
    assert len(lexicon.exceptions) >= 2


def test_scores_against_a_plain_version(spark):
    rng = random.Random(21)
    words = ["trash", "trashy", "idiot", "tr4sh", "can", "board", "x" * 80, "а", "trаsh", "-", "The"]
    lexicon = toxicity.Lexicon({" trash": 2.0, " idiot ": 1.5, " can ": 0.25}, {"trash can", f"{'x' * 80} idiot"}, 1.7)
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(1, "trash"), (1, "trash"), (None, "idiot"), (900, None), (901, ""), (902, ("fine " * 3000 + "trash ") * 40)]

    def plain(text):
        found, total = toxicity.folded(text or "").split(), 0.0
        for k, w in enumerate(found):
            near = {" ".join(found[max(0, k - 1) : k + 1])} - {w} | ({f"{w} {found[k + 1]}"} if k + 1 < len(found) else set())
            total += 0 if near & lexicon.exceptions else 2.0 * w.startswith("trash") + 1.5 * (w == "idiot") + 0.25 * (w == "can")
        return 1 - math.exp(-total / math.sqrt(1 + toxicity.folded(text or "").count(" ") / 2000) / 1.7)

    got = collections.Counter((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.toxicity(table(spark, data), lexicon).collect())
    assert got == collections.Counter((i, round(plain(t), 9), int(plain(t) >= 0.3)) for i, t in data)
    kept = toxicity.accepted(table(spark, data), lexicon)
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter((i, t) for i, t in data if plain(t) < 0.3)


def test_learning_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    one, other = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert (one.weights, one.exceptions, one.scale) == (other.weights, other.exceptions, other.scale) and one.weights


@pytest.mark.parametrize("block", [20, 500_000])
def test_decontamination(spark, block):
    rng = random.Random(6)
    items = [(1, prose(rng, 25)), (2, prose(rng, 4)), (10, "One"), (3, None), (4, " ,, "), (None, prose(rng, 12)), (5, prose(rng, 11))]
    text = {k: v for k, v in items}
    rows = [(1, prose(rng, 9) + ", " + text[1].upper().replace(" ", " - ") + " " + prose(rng, 5)), (2, text[1][: len(text[1]) // 3]), (3, "x " + text[2] + " y one"), (4, None), (5, ""), (6, text[None]), (6, text[None]), (7, prose(rng, 80)), (None, text[5])]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = collections.Counter()
    for i, t in rows:
        words, hit, found = split(t), set(), set()
        for item, b in items:
            w = split(b)
            n = min(10, len(w))
            for k, j in itertools.product(range(len(w) - n + 1 if n else 0), range(len(words) - n + 1)):
                if words[j : j + n] == w[k : k + n]:
                    hit.update(range(j, j + n))
                    found |= {str(item)} - {"None"}
        expected[i, len(words), len(hit), len(found), decontaminate.digest(list(found)), bool(hit)] += 1
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(map(tuple, decontaminate.contamination(docs, bench, block_words=block).drop("spans", "items").collect())) == expected
    for r in decontaminate.contamination(docs, bench, block_words=block).collect():
        ends = r.spans
        assert ends == sorted(set(ends)) and len(ends) % 2 == 0 and sum(ends[1::2]) - sum(ends[::2]) == r.n_hit
    clean = decontaminate.clean(docs, bench, block_words=block)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in expected.items() if not k[-1])


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    return collections.Counter((rows[k][0], len(sets[k]), least[root[k]] if sets[k] else rows[k][0]) for k in range(len(rows)))


def test_wide_bitmaps_reject_no_link():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 257, 3000):
        for lost in range(0, 60, 6):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate([a[len(a) * lost // 100 :], rng.integers(0, 2**64, n * lost // 200, np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert jaccard_join.may_link(jaccard_join.wide_bitmap(a), jaccard_join.wide_bitmap(b), len(a), len(b), 75)
    far = np.arange(4000, dtype=np.uint64)
    assert not jaccard_join.may_link(jaccard_join.wide_bitmap(far[:2000]), jaccard_join.wide_bitmap(far[1000:]), 2000, 3000, 75)


def test_jaccard_join(spark, rows, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 60).split()
    near = []
    for i in range(60):  # a chain of near copies, of which not all link with each other
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = prose(rng, 1)
        near.append((200 + i, " ".join(words[: rng.randint(45, 60)])))
    data = [*rows, *near]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    docs = table(spark, data)
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == brute_components(data)
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    expected = brute_components(data)
    alone = collections.Counter({i: n for (i, size, _), n in expected.items() if not size})
    texts = {c: 1 for _, size, c in expected if size}
    assert collections.Counter(r.doc_id for r in kept.collect()) == alone + collections.Counter(texts)


def test_jaccard_join_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = jaccard_join.near_duplicates(docs, count=False).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_join_keeps_one_copy_of_prefixes(spark, monkeypatch):
    docs, held, wide = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}, []
    put, drop = Scratch.put, Scratch.drop

    def seen(self, df, name, **by):
        held[name] = put(self, df, name, **by)
        wide.append({n for n, x in held.items() if {"prefix", "listed", "p1"} & set(x.columns)})
        return held[name]

    monkeypatch.setattr(Scratch, "put", seen)
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: (drop(self, *names), [held.pop(n, None) for n in names])[0])
    jaccard_join.near_duplicates(docs, count=False).collect()
    assert {"classes", "spread", "marked"} in wide and max(map(len, wide)) == 3  # sketches are no table, lists go once they are not needed
    assert all("sketches" not in x for x in wide) and wide[-1] == {"classes"}


def test_representatives_without_ids(spark):
    text = prose(random.Random(5), 30)
    data = [(None, text), (None, text + " x"), (None, text), (None, None), (None, ""), (7, "own words"), (7, "own words")]
    kept = jaccard_join.representatives(table(spark, data)).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, ""), (0, ""), (0, text[:3]), (7, "own")]


def test_word_codes():
    for trial in range(200):
        rng = random.Random(trial)
        blob = "".join(rng.choice(["a", "B", "é", " ", "\n", "\t", "\x0b", "x" * rng.choice([1, 4095, 4096, 4097, 300_000]) if rng.random() < 0.02 else "q"]) for _ in range(rng.randint(0, 3000))).encode()
        words = blob.lower().split()
        codes, places = jaccard_join.word_codes(blob)
        assert [blob[p : p + len(w)].lower() for p, w in zip(places.tolist(), words, strict=True)] == words
        known = dict(zip(words, codes.tolist(), strict=True))
        assert [known[w] for w in words] == codes.tolist() and len(set(known.values())) == len(known)


def test_jaccard_join_counts_all_links(spark, monkeypatch):
    rng = random.Random(15)
    base, data = [prose(rng, 70).split(), prose(rng, 50).split()], [(0, None), (1, "alone")]
    for i in range(70):
        words = list(base[i % 2])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        data.append((10 + i, " ".join(words)))
    data += [(100, data[5][1].upper().lower()), (101, data[6][1])]
    sets = {}
    for i, t in data:
        w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    classes = set(sets.values()) - {frozenset()}
    expected = {i: sum(100 * len(x & y) >= 75 * len(x | y) for y in classes if y != x) if x else 0 for i, x in sets.items()}
    assert max(expected.values()) > 10
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(table(spark, data)).collect()} == expected


def test_caches_are_bounded_by_bytes(monkeypatch):
    model, words = piece_tokenizer.PieceModel(P.path("piece_bpe_32k.model")), [f"w{k}" for k in range(4000)]
    expected = [x.tolist() for x in model.encode(words)]
    monkeypatch.setattr(piece_tokenizer, "REMEMBERED", 5000)
    model._forget()
    for k in range(0, 4000, 50):
        assert [x.tolist() for x in model.encode(words[k : k + 50])] == expected[k : k + 50] and model.words.held < 5000 + 50 * 200
    counter = token_counts.PairCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    known = [counter.count(f"a {w} {w}x") for w in words]
    monkeypatch.setattr(token_counts, "REMEMBERED", 3000)
    counter = token_counts.PairCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert [counter.count(f"a {w} {w}x") for w in words] == known and counter.held < 4000 and len(counter.chunks) < 100


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"), "t")
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in list(root)}


def test_line_dedup(spark, rows):
    data = list(dict.fromkeys(rows))
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    docs = table(spark, data)
    got = {(r.doc_id, r.text): r.n_removed for r in line_dedup.line_report(docs).collect()}
    texts = dict(data)
    assert ((None, texts[None] or "") in got) and len(got) <= len(order)
    short = {r.doc_id: r for r in line_dedup.line_report(docs).where("doc_id in (10, 23, 24, 30, 31)").collect()}
    assert short[10].n_removed == 1 and short[10].text == "" and short[23].n_removed == short[24].n_removed == 0
    assert short[31].n_removed >= 1 and texts[1] not in short[31].text and texts[31].split("\n")[0] in short[31].text
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == sum(t is None for _, t in data)
    left = line_dedup.deduplicated(docs, emptied=False)
    assert left.columns == docs.columns and left.where("text is null").count() == sum(t is None for _, t in data)
    assert sorted(r.text for r in left.where("text is not null").collect()) == sorted(r.text for r in kept.where("text is not null").collect() if r.text.strip() or r.doc_id in (21, 22))


def test_line_dedup_aligns_all_earlier_documents(spark):
    rng = random.Random(12)
    pool = [prose(rng, n) for n in (2, 2, 3, 3, 4, 5, 20, 20, 25, 30)] + ["", "a"]
    data = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 7)))) for i in range(150)]
    data += [(300, "\n".join(pool[k] for k in (0, 1, 6, 7))), (301, "\n".join([pool[0], "own", pool[1]])), (None, data[7][1]), (400, data[7][1] + " "), (401, None)]
    codes = {i: [x.tolist() for x in line_dedup.line_codes((t or "").encode())] for i, t in data}
    order, expected = sorted(codes, key=lambda i: (i is not None, i or 0)), {}
    for k, i in enumerate(order):
        gone, (b, sizes) = set(), codes[i]
        for j in order[:k]:
            gone |= {x for _, q, n in line_dedup.patience(codes[j][0], b) if sum(sizes[q : q + n]) >= 40 for x in range(q, q + n)}
        expected[i] = "\n".join(x for n, x in enumerate((dict(data)[i] or "").split("\n")) if n not in gone), len(gone)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_report(table(spark, data)).collect()}
    assert got == expected


def test_line_dedup_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(14)
    long = "\n".join(prose(rng, 8) for _ in range(6000))
    data = [(1, long), (2, long + "\nown line " + prose(rng, 9)), (2, long + "\nown line " + prose(rng, 9)), (3, "x" * 3_000_000), (4, "x" * 3_000_000), (4, "x" * 3_000_000), (None, "alone"), (None, "alone"), (5, None), (5, None), (6, ""), (6, "")]
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.line_report(table(spark, data)).collect())
    assert got == collections.Counter((i, t or "") for i, t in brute_lines(data))


def test_patience_brute():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(1, 9) for _ in range(rng.randint(0, 9))] for _ in range(2))
        blocks = line_dedup.patience(a, b)
        assert all(a[i : i + n] == b[j : j + n] and n > 0 for i, j, n in blocks)
        assert all(p + k <= i and q + k <= j for (p, q, k), (i, j, _) in itertools.pairwise(blocks))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1, 2), (3, 4, 1)]


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><!-- x --><div class="ad">buy</div>%s<footer>&copy; me</footer></body></html>'


def test_html(spark):
    pages = [
        (1, "http://h/a/1", PAGE % "<article><h1>T &amp; x</h1><p><b>one\n two<br><p>three<div class='comments'>no</div></article>"),
        (2, "http://h/a/2", PAGE % "<div>shared note</div><p>own text</p>"),
        (3, "http://h/a/3", PAGE % "<div>shared note</div><p>other text</p>"),
        (4, None, None), (5, "http://h/b", ""), (1, "http://h/a/1", "<p>plain &#233;&nbsp;x"), (None, "http://[bad", "<article>q</article>"),
    ]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extracted(spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, lines string")).where("page_id is null or page_id <> 1").collect()}
    assert got == {(2, "http://h/a/2"): ("own text", 8), (3, "http://h/a/3"): ("other text", 10), (4, None): ("", 0), (5, "http://h/b"): ("", 0), (None, "http://[bad"): ("q", 1)}
    again = [(7, "http://h/c", PAGE % "<article>q</article>", "c", 1, 2)] * 3 + [(8, "http://h/d", PAGE % ("<p>" + "word " * 400_000), "c", 1, 2)]
    many = html_extract.extracted(spark.createDataFrame(again, "page_id long, url string, html string, host string, path int, seat int"))
    assert collections.Counter((r.page_id, r.n_chars) for r in many.collect()) == {(7, 1): 3, (8, 1_999_999): 1}
    first = html_extract.extracted(spark.createDataFrame(pages[:1], "page_id long, url string, html string")).first()
    assert first.text == "T & x\n\none two\n\nthree"


@pytest.mark.parametrize(("html", "expected"), [
    ('<div class="layout with-sidebar"><p>real text</p></div>', [("real text", 0)]),
    ('<div class="post" id="main-header-free">post</div><main class="has-sidebar">m</main>', [("post", 0), ("m", 1)]),
    ('<article><h2 id="related-work">h</h2><div class="overflow-hidden">t</div><section id="search">s</section></article>', [("h", 1), ("t", 1), ("s", 1)]),
    ('<div class="ad">x</div><ol class="comment-list"><li><article class="comment-body">c</article></li></ol>ok', [("ok", 0)]),
    ('<div class="sidebar"><article>in</article> no</div>', [("in", 1)]),
    ("<aside><article>no</article></aside>yes<nav>never ends", [("yes", 0), ("never ends", 0)]),
    ('<div hidden>n</div><div data-x="hidden">y</div><p style="display:none">z<p>w', [("y", 0), ("w", 0)]),
    ('<div class="site-header">h</div><header>q</header><article><header><h1>T</h1></header>b<p title="a>b">c</article>', [("T", 1), ("b", 1), ("c", 1)]),
    ("a < b <3 &lt;p> <!-- > --> c", [("a < b <3 <p> c", 0)]),
])
def test_blocks(html, expected):
    assert html_extract.blocks_of(f"<html><body>{html}</body></html>") == expected


@pytest.mark.parametrize("html", ["<a '" * 8000, "<a '" * 8001, "<!" * 50_000, "<" * 100_000, "<form>" * 20_000, "<div class='ad'>" * 20_000, "<article>" * 20_000, "<script>" * 20_000, "<a '>" * 20_000 + "'"])
def test_hostile_pages_are_read_in_time(html):
    began = time.monotonic()
    html_extract.blocks_of(html)
    assert time.monotonic() - began < 3


def test_alignment_of_many_equal_blocks():
    rng, began = random.Random(3), time.monotonic()
    a, b = ([rng.choice("abcdef") for _ in range(4000)] for _ in range(2))
    assert _within([a[i] for i in sorted(html_extract.common_lines(a, b))], b) and time.monotonic() - began < 3


def test_differencing_decides():
    lines, other = ["menu", "own text", "quoted line", "card"], ["menu", "quoted line", "else", "card"]
    assert html_extract.main_text(lines, [0, 1, 1, 2], [other]) == "own text\n\nquoted line"  # the second article is shared, the first is not
    assert html_extract.main_text(lines, [0, 0, 0, 0], [other]) == "own text"
    assert html_extract.main_text(lines, [0, 0, 0, 0], [lines]) == "\n\n".join(lines)  # a copy says nothing
    assert html_extract.main_text(["menu", "card"], [0, 1], [["menu", "card", "x"]]) == "card"


def test_html_pages_with_neighbours_in_other_partitions(spark):
    pages = [(i, f"http://h/{i:03d}", PAGE % f"<div>shared</div><p>text {i}</p>" if i % 9 else None) for i in range(90)] * 2
    parts = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(40)
    with_many = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = collections.Counter((r.page_id, r.text) for r in html_extract.extracted(parts).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_many)
    assert sum(got.values()) == 180 and all(text in ("", f"text {i}", f"shared\n\ntext {i}") for i, text in got)
    assert all(got[i, ""] == 2 for i in range(0, 90, 9))


def test_common_lines_brute():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) if any(_within(c, b) for c in itertools.combinations(a, n)))
        found = html_extract.common_lines(a, b)
        assert len(found) == best and _within([a[i] for i in sorted(found)], b)


def _within(part, whole):
    it = iter(whole)
    return all(x in it for x in part)


def brute_lines(data):
    """What alignment with all earlier documents leaves of each row's text; None for null."""
    order = sorted({(i, t or "") for i, t in data}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    codes = {k: [x.tolist() for x in line_dedup.line_codes(k[1].encode())] for k in order}
    kept = {}
    for k, row in enumerate(order):
        gone, (b, sizes) = set(), codes[row]
        for other in order[:k]:
            gone |= {x for _, q, n in line_dedup.patience(codes[other][0], b) if sum(sizes[q : q + n]) >= 40 for x in range(q, q + n)}
        kept[row] = "\n".join(x for n, x in enumerate(row[1].split("\n")) if n not in gone)
    return [(i, None if t is None else kept[i, t]) for i, t in data]


def brute_hit(items, text):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [split(b) for _, b in items]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in found if w for k in range(len(w) - min(10, len(w)) + 1)}
    words = split(text)
    return any(tuple(words[j : j + n]) in windows for n in {len(w) for w in windows} for j in range(len(words) - n + 1))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(31)
    lines = [prose(rng, n) for n in (12, 14, 16, 9, 20, 25)]
    items = [(1, prose(rng, 14)), (2, None), (None, prose(rng, 11))]
    data = []
    for i in range(150):
        text = [prose(rng, rng.randint(20, 40)), *rng.sample(lines, rng.randint(0, 2)), prose(rng, rng.randint(5, 30))]
        if i % 5 == 0:
            text.insert(1, "you st\u0443pid 1diot, " + prose(rng, 4))
        if i % 11 == 0:
            text.append(items[0][1].upper().replace(" ", ", "))
        data.append((i, "\n".join(text)))
    near = data[7][1].split()
    data += [(200, " ".join([*near[:-1], "other"])), (201, data[8][1]), (201, data[8][1]), (202, lines[0] + "\n" + lines[1]), (203, None), (204, ""), (204, ""), (205, " \n "), (None, data[9][1]), (None, None), (206, items[2][1]), (207, prose(rng, 30) * 400)]
    order = [0, *rng.sample(range(1, len(data)), len(data) - 1)]
    spark.createDataFrame([(*data[k], "en", "s", 3, 1, 0.5, 9) for k in order], "doc_id long, text string, lang string, source string, n_chars long, same long, score double, gid long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)] + [(3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.weights
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    count = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    steps = [data]
    steps.append([(i, t) for i, t in data if lexicon.score(t or "") < 0.3])
    steps.append([(i, t) for (i, old), (_, t) in zip(steps[1], brute_lines(steps[1]), strict=True) if (t or "").strip() or not (old or "").strip()])
    components = brute_components(steps[2])
    assert len(steps[0]) > len(steps[1]) > len(steps[2]) and steps[1] != steps[2]
    store, after = Scratch(spark, "stages"), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, after, str(tmp_path))
        if k == 4:
            break
        assert made.columns == docs.columns
        after = store.put(made, name)
        if k < 2:
            assert count(after) == collections.Counter(steps[k + 1]), name
        elif k == 2:
            ids = collections.Counter({i: n for (i, size, _), n in components.items() if not size}) + collections.Counter({c: 1 for _, size, c in components if size})
            assert collections.Counter(r.doc_id for r in after.collect()) == ids and count(after) <= collections.Counter(steps[2])
            steps.append([(r.doc_id, r.text) for r in after.collect()])
        else:
            steps.append([(i, t) for i, t in steps[3] if not brute_hit(items, t)])
            assert count(after) == collections.Counter(steps[4]) and len(steps[4]) < len(steps[3]) < len(steps[2])
    expected = collections.Counter()
    for i, t in steps[4]:
        ids = lib.encode(t or "")
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, made.collect())) == expected
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == collections.Counter(i for i, _ in steps[4])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.collect() == [], name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect() == []


def test_bitmaps_never_claim_too_much():
    rng = np.random.default_rng(3)
    for n in (1, 40, 700, 5000):
        pool = rng.integers(0, 2**63, 2 * n, np.uint64)
        a, b = np.unique(pool[: n + n // 3]), np.unique(pool[n // 3 : n + n // 2])
        x, y = (jaccard_join.bitmap(c).view(np.uint64) for c in (a, b))
        lacking = int(np.bitwise_count(x & ~y).sum())
        assert lacking <= len(np.setdiff1d(a, b))
