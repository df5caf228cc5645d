"""Text operators against brute force on a table with nulls, empty and long texts, copies and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from panolake.llm import bpe, fingerprints, license_scan, lines, packing, simhash, substring, token_store, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, fp string, keys string, word string, part string, n_removed string, folded string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(7)
    passage, block = sentence(r, 70), "\n".join(sentence(r, 9) for _ in range(14))
    rows = [(i, sentence(r, r.randint(1, 150)) + "\n" + sentence(r, 30)) for i in range(30)]
    rows += [(30 + i, sentence(r, 12) + "\n" + passage + " " + sentence(r, 11)) for i in range(8)]
    rows += [(40 + i, sentence(r, 5) + "\n" + block + "\n" + sentence(r, 6)) for i in range(6)]
    copy = sentence(r, 120)
    rows += [(50 + i, copy) for i in range(5)] + [(56, copy[:-9] + "zz zz.")]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "a " * 3000), (64, "x" * 1500), (65, "  two  spaces \n\n end "), (66, "don't stop 12 345 ÄÖÜ 日本語 テキスト"), (67, "Licensed under the Apache License, Version 2.0.")]
    rows += [(68, " ".join(sentence(r, 40) for _ in range(200))), (20, rows[20][1]), (None, "no id " * 30), (70, "b " * 49 + "c"), (71, "b " * 49 + "c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "0", "q", "f") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, str(x[1:])))


def test_bpe(spark, docs, nothing, texts):
    import tiktoken

    ranks = bpe.Ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"]).decode()) for r in bpe.decode(bpe.encode(docs, ranks, kept=40), ranks).collect()]
    assert pairs(got) == pairs([(i, own.encode_ordinary(t or ""), t or "") for i, t in texts])
    at_once = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"]).decode()) for r in bpe.encode(docs, ranks, kept=40, then=bpe.Decoder(spark, ranks)).collect()]
    assert pairs(at_once) == pairs(got)
    assert bpe.encode(nothing, ranks).count() == 0


def test_token_store(spark, docs, nothing, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    at, code = token_store.write_ids(docs.where("doc_id is not null"), path, 0)
    got = sorted((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_store.read_ids(spark, at).collect())
    want, start = [], 0
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, ids))
        start += len(ids)
    assert got == want
    assert sum(2.0 ** -int(b) for b in code.lengths if b) <= 1 and code.lengths.max() <= code.max_bits
    assert token_store.read_ids(spark, token_store.write_ids(nothing, path, 0)[0]).count() == 0


def test_length_limit():
    counts = {i: 2**i for i in range(30)}
    code = token_store.limited_code(counts, 8)
    assert code.lengths.max() <= 8 and sum(2.0 ** -int(b) for b in code.lengths) == 1
    ids = np.array([i % 30 for i in range(5000)])
    payload, begins = token_store.pack_bits(ids, code.lengths, code.codes())
    back = token_store.unpack_bits([(np.frombuffer(payload, np.uint8), begins[:: token_store.EVERY], len(ids))], *code.table(), code.max_bits)
    assert (back[0] == ids).all()


def test_packing(docs, nothing, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    known = docs.where("doc_id is not null and doc_id <> 20")
    got = packing.pack(known, path, 2).toPandas()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts if i is not None and i != 20}
    for row in got.itertuples():
        assert zlib.crc32(ids[row.doc_id][row.start : row.start + row.length].tobytes()) == row.ids_crc32 and row.doc_tokens == len(ids[row.doc_id])
    assert got.length.sum() == sum(map(len, ids.values()))
    ordered = got.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert packing.pack(nothing, path, 2).count() == 0 and packing.pack(docs, path, 2).count() >= len(texts)


def test_best_cuts_are_least():
    r = random.Random(3)
    for _ in range(40):
        steps = [r.randint(1, 9) for _ in range(r.randint(1, 12))]
        places = np.cumsum([0, *steps])
        penalty = np.array([0.0, *(r.choice([0.0, 2.0, 5.0]) for _ in steps)])

        def cost(cuts):
            total = 0.0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = places[b] - places[a]
                if n > 16:
                    return float("inf")
                total += penalty[b] + (0 if n & (n - 1) == 0 else 16 - n)
            return total

        n = len(places)
        every = ([0, *(i for i in range(1, n - 1) if m >> (i - 1) & 1), n - 1] for m in range(1 << max(0, n - 2)))
        found = np.searchsorted(places, packing.best_cuts(places, penalty, 16)).tolist()
        assert cost(found) == min(cost(c) for c in every)


def brute_fingerprint(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, nothing, texts):
    got = pairs((r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.near_duplicates(docs).collect())
    assert got == pairs((i, brute_fingerprint(t or "")) for i, t in texts)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_classes(spark, monkeypatch):
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for _ in range(6):
            w = v
            for b in r.sample(range(64), r.randint(1, 7)):
                w ^= 1 << b
            values.append(w)
    hot = r.getrandbits(64)
    values += [hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    values = sorted(set(values))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(e["a"] % (1 << 64), e["b"] % (1 << 64)) for e in simhash.links(fps).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)

    def classes(links):
        root = {v: v for v in values}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
        return [top(v) for v in values]

    assert classes(edges) == classes([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])


def test_substring(docs, nothing, texts):
    first: dict[tuple, int] = {}
    cut = {}
    for i, t in texts:
        words = WORD.findall(t or "")
        for p in range(len(words) - 49):
            if i is not None:
                key = tuple(words[p : p + 50])
                first[key] = min(first.get(key, 1 << 62), i)
    for i, t in texts:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for p in range(len(words) - 49):
            if i is not None and first[tuple(words[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        cut[i, t] = ([w for w, g in zip(words, gone, strict=True) if not g], sum(gone))
    done = substring.dedup_substrings(docs)
    got = pairs((r["doc_id"], WORD.findall(r["text"] or ""), r["n_removed"]) for r in done.collect())
    assert got == pairs((i, *cut[i, t]) for i, t in texts)
    assert substring.dedup_substrings(docs, counts=False).columns == docs.columns
    assert substring.dedup_substrings(nothing, counts=False).count() == 0


def test_lines(docs, nothing, texts):
    def chunks(text):
        ls = text.split("\n")
        hs = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        out, start = [], 0
        for k in range(len(ls)):
            if k == len(ls) - 1 or k and (hs[k] + 31 * hs[k - 1]) % lines.EACH == 0:
                out.append(ls[start : k + 1])
                start = k + 1
        return out

    unique = sorted({x for x in texts if x[0] is not None})
    seen, want = set(), {}
    for i, t in unique:
        kept = []
        for c in chunks(t or ""):
            key = "\n".join(c)
            if len(c) < 2 or key not in seen:
                kept += c
            if len(c) >= 2:
                seen.add(key)
        want[i] = "\n".join(kept)
    done = lines.dedup_lines(docs.where("doc_id is not null"))
    assert {r["doc_id"]: r["text"] or "" for r in done.collect()} == want
    assert done.where("n_removed > 0").count() >= 5
    assert lines.dedup_lines(docs, counts=False).columns == docs.columns
    assert lines.dedup_lines(nothing, counts=False).count() == 0


def test_many_lines(spark):
    """Work grows with a text's lines; names like the operators' own stay whole."""
    r = random.Random(8)
    text = "\n".join(str(r.getrandbits(40)) for _ in range(100_000))
    docs = spark.createDataFrame([(1, text, "a", "b", 5), (2, text, "c", "d", 6)], "doc_id long, text string, __key string, gone string, n_lines int")
    one, two = sorted(lines.dedup_lines(docs).collect(), key=lambda x: x["doc_id"])
    assert one["text"] == text and one["n_removed"] == 0 and (one["__key"], one["gone"], one["n_lines"]) == ("a", "b", 100_000)
    assert 0 < len(two["text"]) < 0.2 * len(text) and two["n_removed"] == 100_000 - two["text"].count("\n") - 1
    assert lines.dedup_lines(docs, counts=False).columns == docs.columns


def test_one_id_keeps_one(spark):
    chunk = "\n".join(f"line {i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a\n" + chunk), (1, "b\n" + chunk), (None, "c\n" + chunk), (None, chunk)], "doc_id long, text string")
    done = lines.dedup_lines(docs).collect()
    assert sum("line 20\n" in x["text"] for x in done) == 1 and next(x for x in done if "line 20\n" in x["text"])["doc_id"] == 1


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, "p", 1, "q"), (2, words, "r", 2, "s")], "doc_id long, text string, __text string, n_removed int, rest string")
    got = sorted(substring.dedup_substrings(docs).collect(), key=lambda x: x["doc_id"])
    assert [(x["__text"], x["n_removed"], x["rest"]) for x in got] == [("p", 0, "q"), ("r", 60, "s")]
    got = sorted(substring.dedup_substrings(docs, counts=False).collect(), key=lambda x: x["doc_id"])
    assert [(x["__text"], x["n_removed"], x["rest"]) for x in got] == [("p", 1, "q"), ("r", 2, "s")]


def brute_winnow(text: str) -> list[int]:
    hs = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in WORD.findall(text)]
    prime, base = (1 << 31) - 1, 1_000_003
    grams = []
    for i in range(max(len(hs) - 3, min(len(hs), 1))):
        h = [*hs[i : i + 4], 0, 0, 0][:4]
        grams.append(sum(x * pow(base, 3 - k, prime) for k, x in enumerate(h)) % prime)
    kept = []
    for j in range(max(len(grams) - 7, min(len(grams), 1))):
        window = grams[j : j + 8]
        at = max(i for i, g in enumerate(window) if g == min(window)) + j
        if (grams[at], at) not in kept[-1:]:
            kept.append((grams[at], at))
    return [g << 32 | (1 << 32) - 1 - at for g, at in kept]


def order_of(row: tuple[int | None, str]) -> tuple:
    i, t = row
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return (-(1 << 63) if i is None else i, h - (1 << 64) if h >> 63 else h, t)


def check_next(rows, texts):
    order = sorted([(i, t or "") for i, t in texts], key=order_of)
    after = [(a[0], a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in rows), key=str) == sorted(after, key=str)


def test_winnowing(docs, nothing, texts):
    rows = fingerprints.with_next(docs.select("doc_id", "text")).collect()
    check_next(rows, texts)
    for r in rows:
        assert r["fp"] == brute_winnow(r["text"]) and r["next_fp"] == brute_winnow(r["next_text"])
    ties = "a b c d " * 10
    own = docs.limit(1).select(fingerprints.winnow(F.lit(ties)).alias("fp"), fingerprints.positions(fingerprints.winnow(F.lit(ties))).alias("at")).first()
    assert own["fp"] == brute_winnow(ties) and own["at"][0] in range(4, 8)  # of equal grams the rightmost of the window
    assert fingerprints.with_next(nothing.select("doc_id", "text")).count() == 0


def test_hot_ids_are_split(spark):
    r = random.Random(6)
    texts = [(None, sentence(r, 5)) for _ in range(200)] + [(7, sentence(r, 5)) for _ in range(200)] + [(i, sentence(r, 5)) for i in range(200)] + [(7, "same")] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check_next(fingerprints.with_next(docs).collect(), texts)
    sizes = [x["count"] for x in fingerprints.ranged(docs, 8).groupBy("part").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == len(texts)
    one = spark.createDataFrame([(5, "alone here")], "doc_id long, text string")
    check_next(fingerprints.with_next(one).collect(), [(5, "alone here")])


def test_edited_texts(spark, tmp_path):
    """The query itself: edited text and both likenesses, by brute force."""
    r = random.Random(7)
    texts = [(i, sentence(r, r.randint(0, 40)) if i % 7 else (None if i % 2 else "")) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def like(a, b):
        a, b = ({x >> 32 for x in brute_winnow(t)} for t in (a, b))
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    plain = [t or "" for _, t in texts]
    for x in fingerprints.op10_fingerprints(spark, str(tmp_path)).collect():
        text, after = plain[x["doc_id"]], plain[(x["doc_id"] + 1) % 40]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == digest(edited)
        assert x["fingerprint"] == digest(",".join(map(str, brute_winnow(text)))) and x["edited_fingerprint"] == digest(",".join(map(str, brute_winnow(edited))))
        assert abs(x["near_edited"] - like(text, edited)) < 1e-12 and abs(x["near_next"] - like(text, after)) < 1e-12


def test_licenses(docs, nothing):
    got = license_scan.scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in got] == [(67, "Apache-2.0", 1.0)]
    assert license_scan.scan(nothing).count() == 0


def test_license_alignment():
    r = random.Random(2)
    known = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    for name in ("MIT-text", "BSD", "GPL-3.0-header"):
        template = known.words[name]
        noisy = [w for w in template if r.random() > 0.08]
        filler = ["zu", "ka", "the", "of"] * 100
        hits = [h for h in known.found(" ".join([*filler, *noisy, *filler, *noisy])) if h[0] == name]
        assert len(hits) == 2 and all(0.8 <= h[1] <= 1 for h in hits)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(30):
        template = [str(i) for i in r.sample(range(100), 30)]
        text = [w for w in template if r.random() > 0.2]
        assert len(license_scan.align(text, template)) == longest(text, template)


def test_toxicity(spark, nothing):
    r = random.Random(4)
    rows = []
    for i in range(600):
        words = sentence(r, r.randint(5, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["rotter", "r0tter", "Wretch", "wr3tch"]))
        rows.append((i, " ".join(words), int(bad)))
    rows += [(1000, None, None), (1001, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text", F.lit("x").alias("folded")), table.select("doc_id", "toxic")
    lexicon = toxicity.learn(docs, labels, toxicity.remainder() != 0)
    scored = {x["doc_id"]: x["score"] for x in toxicity.score(docs, lexicon).collect()}
    right = sum((scored[i] >= 0.5) == bool(y) for i, _, y in rows if y is not None)
    assert right >= 0.97 * 600 and scored[1000] < 0.5 and scored[1001] < 0.5
    assert toxicity.kept(docs, lexicon).columns == docs.columns
    assert toxicity.kept(docs, lexicon).count() == sum(x < 0.5 for x in scored.values())
    spared = toxicity.matched(toxicity.Lexicon({" trash ": 2.0}, (0.0, 1.0, 1.0)).automaton(), " put it in the trash can and trash ")
    assert spared == 2.0
    empty = toxicity.learn(nothing, labels.limit(0), toxicity.remainder() != 0)
    assert not empty.terms and [x["score"] for x in toxicity.score(docs.limit(2), empty).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("word", ["idiot", "ID\u200bIOT", "\u0131diot", "\uff49\uff44\uff49\uff4f\uff54", "id\u00edot", "\u00efdiot", "i.d.i.o.t", "!d!0t", "1d10t", "i-d-i-o-t", "i d i o t", "\u0456diot", "idi\u03bft", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d"])
def test_disguises(word):
    import pyarrow as pa

    automaton = toxicity.Lexicon({" idiot ": 2.0}, (0.0, 1.0, 1.0)).automaton()
    texts = [f"You {word}!", f"({word})", word, f"not an {word}", "an idiotic plan", "U.S.A. 101 caf\u00e9 a b c"]
    assert [toxicity.matched(automaton, t) for t in toxicity.fold(pa.array(texts)).to_pylist()] == [2.0, 2.0, 2.0, 0.0, 0.0, 0.0]


def test_toxicity_formula(spark):
    """Scores against the formula worked out text by text; learned exceptions; the same lexicon each time."""
    r = random.Random(9)
    rows = []
    for i in range(500):
        words = sentence(r, r.randint(20, 60)).split()
        if i % 5 == 0:
            words[3:3] = ["rotter"] * r.randint(1, 3)
        elif i % 5 == 1:
            words[3:3] = ["garden", "rotter"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    lexicon = toxicity.learn(table, table, toxicity.remainder() != 0, purity=0.4)
    assert lexicon == toxicity.learn(table.orderBy(F.desc("doc_id")), table, toxicity.remainder() != 0, purity=0.4)
    assert "garden rotter" in lexicon.harmless and any(t.strip() in "rotter" for t in lexicon.terms)
    a, b, c = lexicon.curve
    got = {x["doc_id"]: x["score"] for x in toxicity.score(table, lexicon).collect()}
    for i, t, _ in rows:
        plain = f" {' '.join(re.findall('[a-zé]+', t.lower()))} "
        spared = plain
        for phrase in sorted({*lexicon.harmless, *toxicity.EXCEPTIONS}, key=len):
            spared = spared.replace(f" {phrase} ", " # ")
        weight = sum(w * len(re.findall(f"(?={re.escape(term)})", spared)) for term, w in lexicon.terms.items())
        z = a + b * np.log1p(weight) + c * np.log1p(100 * weight / max(1, plain.count(" ") - 1))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9, (i, weight)
