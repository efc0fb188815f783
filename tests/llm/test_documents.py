"""Operators on documents against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from brightshelf.llm import alike, licences, packing, pieces, quality, recompress, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """The smallest id reachable over fingerprints at distance 3 or less, by fingerprint."""
    fps = sorted(set(fp for _, fp in prints))
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    least = {}
    for d, fp in prints:
        if d is not None:
            least[root(fp)] = min(d, least.get(root(fp), d))
    return {f: least.get(root(f)) for f in fps}


@pytest.mark.parametrize("hot", [1024, 2])
def test_simhash(docs, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = rows_of(docs)
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = plain_groups(prints)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, fp, expected[fp]) for d, fp in prints), key=str)


def test_trie_join_of_a_dense_cluster():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 5, 400)]
    x = np.unique(np.append(centre ^ np.array(flips, dtype=np.uint64), rng.integers(0, 1 << 63, 400, dtype=np.uint64)))
    whole = np.array([0]), np.array([len(x)])
    i, j = simhash.trie_pairs(x, *whole, *whole, np.array([0]), 64)
    a, b = np.triu_indices(len(x), 1)
    apart = x[a] ^ x[b]
    near = (np.bitwise_count(apart) <= 3) & (np.bitwise_count(apart >> np.uint64(32)) <= 1)
    found = sorted(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    # A pair of leaves is compared by all its bits, so a few are found that the other trie finds too.
    assert set(zip(a[near].tolist(), b[near].tolist(), strict=True)) <= set(found) and len(set(found)) == len(found)
    assert all((x[p] ^ x[q]).item().bit_count() <= 3 for p, q in found)


@pytest.mark.parametrize("hot", [1024, 3])
def test_trie_join_of_many_fingerprints(spark, hot, monkeypatch):
    """Groups of fingerprints around common ones, some of them of rows without an id alone, against all pairs."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    prints = []
    for centre in rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        for _ in range(12):
            prints.append((int(rng.integers(0, 5000)) if rng.random() < 0.7 else None, centre))
            for bit in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                centre ^= 1 << bit
    df = spark.createDataFrame([(d, fp - (fp >> 63 << 64)) for d, fp in prints], "doc_id long, fp long").repartition(3)
    want = plain_groups(prints)
    assert {r["fp"] % (1 << 64): r["component_id"] for r in simhash.groups(df).collect()} == want


def test_a_fingerprint_without_an_id_joins_its_neighbours(spark):
    df = spark.createDataFrame([(1, 0), (None, 0b111), (2, 0b111111), (None, 1 << 40)], "doc_id long, fp long")
    assert {r["fp"]: r["component_id"] for r in simhash.groups(df).collect()} == {0: 1, 0b111: 1, 0b111111: 1, 1 << 40: 1}
    assert {r["fp"]: r["component_id"] for r in simhash.groups(df.where("doc_id is null")).collect()} == {0b111: None, 1 << 40: None}


def test_one_of_each_keeps_all_columns(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = plain_groups([(d, plain_fingerprint(t)) for d, t in rows_of(docs)])
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted({v for v in expected.values()})


def test_rows_without_any_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "completely other words here")], "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 2


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_sentencepiece(docs, processor):
    got = sorted((tuple(r) for r in pieces.round_trip(docs, P.path("piece_bpe_32k.model")).collect()), key=str)
    want = []
    for d, t in rows_of(docs):
        ids = processor.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids))))
    assert got == sorted(want, key=str)


def test_sentencepiece_decodes_what_it_encodes(docs, processor):
    path = P.path("piece_bpe_32k.model")
    decoded = pieces.decode(pieces.encode(docs, path), path)
    assert sorted(r["decoded"] for r in decoded.collect()) == sorted(processor.decode(processor.encode(t or "")) for _, t in rows_of(docs))


def test_packing(docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20_000)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((d is None, d or 0, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for d, t in rows_of(docs))
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and {r["window"] for r in s} == {at if at & (at - 1) == 0 else 2048}
        padding += s[0]["window"] - at
    assert padding <= 2048 * (docs.rdd.getNumPartitions() + sum(r["length"] for r in rows) // 20_000)
    documents = defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
    by_id = defaultdict(list)
    for missing, d, ids in want:
        by_id[None if missing else d].append(ids)
    assert set(documents) == set(by_id)
    for d, parts in documents.items():
        if len(by_id[d]) == 1:
            ids, at = by_id[d][0], 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
                assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
                at += r["length"]
            assert at == len(ids) // 4
    filled = defaultdict(int)
    for s in sequences.values():
        filled[s[0]["step_group"]] += s[0]["window"]
    assert max(filled.values()) <= packing.STEP


def test_chunks_agree_with_the_tokenizer(texts):
    vocabulary = open(P.path("byte_bpe_50k.json")).read()
    full = Tokenizer.from_str(vocabulary)
    tricky = ["a <|endoftext|> b", "a  b \n c  ", "nbsp\u00a0 x \u3000 y", " lead", "trail ", "\n \n", "x\u0085 y", "it's  I'll", "a\0b c", "one.\nTwo \nthree\n four\n\nfive\n", "\nx\ny z\u00ad\nw", "a b\nc\nd e", "é\nñ 1\n2"]
    for quick in (False, True):
        tokens = packing.ByteTokens(vocabulary, quick)
        found = [ids for _, part in tokens.ids([*texts, *tricky]) for ids in part]
        for t, ids in zip([*texts, *tricky], found, strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == full.encode(t or "", add_special_tokens=False).ids


def test_special_strings_without_spaces():
    """Their texts are printable, unbroken and of ASCII, and still the library's alone."""
    vocabulary = open(P.path("byte_bpe_50k.json")).read()
    full = Tokenizer.from_str(vocabulary)
    s = "<|endoftext|>"
    texts = [s, f"x{s}y", f"{s}\n{s}", f"{s}x", f"x{s}", s * 3, f"{s} ", f" {s}", f"é{s}", f"<|{s}|>", "<|endoftext|", f"a\n{s}b\nc", f"{s}{s[:-1]}"]
    rng = random.Random(9)
    signs = [s, s, "<|", "|>", "a", "Z", "1", "é", "\n", ".", "'s", "the", "\0", "日", " "]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    want = [x.ids for x in full.encode_batch(texts, add_special_tokens=False)]
    for quick in (False, True):
        tokens = packing.ByteTokens(vocabulary, quick)
        assert [np.frombuffer(ids, dtype="<u4").tolist() for _, part in tokens.ids(texts) for ids in part] == want
    assert tokens.agrees()


def plain_removals(rows):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    order = lambda d: float("inf") if d is None else d
    least = {}
    for d, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(order(d), least.get(key, order(d)))
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < order(d):
                gone[k : k + 13] = [True] * 13
        yield d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_substring_dedup(docs, monkeypatch):
    monkeypatch.setattr(recompress, "AT_ONCE", 3000)
    want = sorted(plain_removals(rows_of(docs)), key=str)
    assert sum(x[2] for x in want) > 500
    got = sorted((tuple(r) for r in recompress.removals(docs).collect()), key=str)
    assert got == want
    assert sorted((tuple(r) for r in recompress.digests(docs).collect()), key=str) == sorted(((d, n, m, sha(k)) for d, n, m, k in want), key=str)


def test_texts_without_repeats_stay_as_they_were(docs):
    out = recompress.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(d, t if not m else k) for (d, t), (_, _, m, k) in zip(rows_of(docs), plain_removals(rows_of(docs)), strict=True)]
    assert got == sorted(want, key=str)


def test_quality_of_held_out_documents(spark, small):
    documents, labels = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{small[:-5]}0.01/labels.parquet")
    scored = quality.scored(documents, labels).join(labels, "doc_id")
    held = scored.where("held_out").select("predicted", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    good = [r["predicted"] for r in held if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good)


def plain_scores(documents, labels):
    """Quadratic discriminant scores by sample covariances and matrix inverses; ties and nulls as fit() has them."""
    votes = defaultdict(list)
    for d, q in labels:
        if d is not None and q in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1:
            votes[d].append(q)
    of = {d: int(sum(v) >= len(v) / 2) for d, v in votes.items()}
    x = np.array([quality.statistics(t) for _, t in documents])
    y = np.array([of.get(d, -1) for d, _ in documents])
    seen = x[y >= 0]
    centre, scale = seen.mean(axis=0), seen.std(axis=0)
    scale[scale < 1e-6] = 1
    z, log = (x - centre) / scale, []
    pooled = sum((y == c).sum() * np.cov(z[y == c].T, bias=True) for c in (0, 1)) / len(seen)
    for c in (0, 1):
        own = z[y == c]
        cov = (1 - quality.POOLED) * np.cov(own.T, bias=True) + quality.POOLED * pooled
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = z - own.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        log.append(np.log((len(own) + 1) / (len(seen) + 2)) - 0.5 * distance - 0.5 * np.linalg.slogdet(cov)[1])
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def test_quality_against_brute_force(spark, small):
    documents, labels = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{small[:-5]}0.01/labels.parquet")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "word " * 200_000), (-3, "tie"), (-3, "tie")], "doc_id long, text string")
    documents = documents.select("doc_id", "text").union(extra)
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(-3, 0), (-3, 1), (None, 1), (-2, None)], "doc_id long, quality int"))
    rows = sorted(rows_of(documents), key=str)
    want = plain_scores(rows, [tuple(r) for r in labels.collect()])
    got = sorted(quality.scored(documents, labels).select("doc_id", "score", "predicted").collect(), key=lambda r: str(r["doc_id"]))
    by_id = defaultdict(list)
    for (d, _), s in zip(rows, want, strict=True):
        by_id[d].append(s)
    assert len(got) == len(rows)
    for r in got:
        assert min(abs(r["score"] - s) for s in by_id[r["doc_id"]]) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)
    assert sorted(str(r["doc_id"]) for r in quality.kept(documents, labels).collect()) == sorted(str(r["doc_id"]) for r in got if r["score"] >= 0.5)


def test_quality_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 90, 3)] + [(3, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality.scored(docs, labels.limit(0)).where("score is null").count() == 0


def test_licences(spark):
    notices = {
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under the Frobnicate Terms, see elsewhere.": "unknown",
    }
    plain = ["He lost his driving license in May.", "Nothing of the kind.", "", "Permission to leave was given to nobody."]
    rows = [(k, f"First line.\n{t}\nLast line.", 1) for k, t in enumerate([*notices, *plain])] + [(None, None, None), (0, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scan(df).collect()}
    assert got == {(k, 1): f for k, f in enumerate(notices.values())}


def test_licence_expressions_agree_with_the_model(spark):
    model = licences.trained()
    samples = [*(t for x in licences.TEMPLATES.values() for t in x)]
    df = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    for r in licences.scan(df).collect():
        assert abs(r["probability"] - 1 + model.probabilities(samples[r["doc_id"]])[-1]) < 1e-5
        assert r["confirmed"]


def judged(text):
    """(family or none, whether confirmed) of lines, read plainly."""
    model = licences.trained()
    p, w = model.probabilities(text), licences.words(text)
    best = model.classes[p[:-1].argmax()]
    alike = max((held_share(w, t) for t in licences.TEMPLATES.get(best, ())), default=0.0)
    sure = 1 - p[-1] >= model.threshold
    named = best in licences.NAMES and re.search(licences.NAMES[best], text.lower()) is not None
    confirmed = sure and (alike >= licences.CONFIRMED or named) or named and len(w) <= licences.FEW
    return (best if confirmed else "unknown" if sure else None), confirmed


def held_share(w, template):
    own = licences.shingles(licences.words(template))
    width = own[0].count(" ") + 1
    return len({" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} & set(own)) / len(own)


def wrapped_runs(lines, template):
    """Runs of over one line that hold the template: of the first line that ends one, the latest start; then from the next line on."""
    w, free = [licences.words(x) for x in lines], 0
    if held_share([x for y in w for x in y], template) < licences.CONFIRMED:
        return
    for z in range(len(lines)):
        for a in range(z, free - 1, -1):
            if not w[a]:
                break
            if held_share([x for y in w[a : z + 1] for x in y], template) >= licences.CONFIRMED:
                if a < z:
                    yield a, z
                free = z + 1
                break


def plain_notices(rows):
    """Every line of every text through the model, whatever words it has, and every run that holds a template: (id, line, family, text)."""
    for d, text in rows:
        lines = [] if text is None else text.split("\n")
        found = [(k, k, *judged(x)) for k, x in enumerate(lines)]
        runs = {r for x in licences.TEMPLATES.values() for t in x for r in wrapped_runs(lines, t)} if len(lines) < 3000 else ()
        found += [(a, z, *judged("\n".join(lines[a : z + 1]))) for a, z in runs]
        found = [(a, z, f, sure) for a, z, f, sure in found if f and (sure or a == z)]
        for a, z, f, sure in found:
            spoken = any(s and (b < a <= y or b == a) for b, y, _, s in found)
            if (sure or not spoken) and z == max(y for b, y, g, _ in found if (b, g) == (a, f)):
                yield d, a, f, "\n".join(lines[a : z + 1])


def test_notices_against_brute_force(spark, small):
    """No line is lost for want of a trigger, and runs are found however many lines they have."""
    import textwrap

    documents = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet").select("doc_id", "text")
    mit, bsd = (max(licences.TEMPLATES[f], key=len) for f in ("mit", "bsd"))
    wrap = lambda t, width: textwrap.fill(t, width, break_long_words=False)
    extra = ["Software free of charge to any person, in the Software without restriction", "of this software and associated documentation files", "the work of the foundation " * 3000, "Licensed under the MIT License.\n" * 2000, "\n\n", None, "cc"]
    extra += ["This is dedicated to the public domain", "Dual licensed MIT/Apache", "\n".join(mit.split()), f"{wrap(mit, 14)}\n{wrap(mit, 14)}", f"{wrap(mit, 30)}\n{wrap(bsd, 20)}\n\n{wrap(bsd, 50)}"]
    half = wrap(mit, 20).split("\n")
    extra += ["\n".join([*half[:6], "", *half]), "\n".join([*half[:6], " - ", *half[6:]]), "\n".join([*half[:6], mit, *half[6:]]), f"one {wrap(mit, 25)} {wrap(mit, 25)}"]
    extra = spark.createDataFrame([(-k - 1, t) for k, t in enumerate([*extra, *licences.OTHER_NOTICES, *licences.OTHERS])] + [(None, "Licensed under CC BY."), (None, "Licensed under CC BY.")], "doc_id long, text string")
    documents = documents.union(extra)
    want = sorted(plain_notices(rows_of(documents)), key=str)
    got = sorted(((r["doc_id"], r["paragraph"], r["family"], r["text"]) for r in licences.scan(documents).collect()), key=str)
    assert got == want and len({f for _, _, f, _ in want}) > 5 and max(t.count("\n") for *_, t in want) > 15


def test_templates_cannot_be_held_without_a_trigger():
    single = [t for t in licences.TRIGGERS if t.isalpha()]
    for family, own in licences._templates():
        silent = [s for s in own if not any(t in w for t in single for w in s.split())]
        assert len(silent) / len(own) < licences.CONFIRMED, family


def test_what_the_triggers_lose_of_the_examples():
    import random

    model = licences.trained()
    notices = [t for c, t, _ in licences._examples(random.Random(licences.SEED)) if c != licences.NONE and 1 - model.probabilities(t)[-1] >= model.threshold]
    assert np.mean([not any(x in t for x in licences.TRIGGERS) for t in notices]) <= 0.01


def test_held_out_notices():
    """Of paragraphs that the model was not fitted to, words left out of them and prose around: what is no notice seldom passes,
    though half of it is words of notices; most notices of a family do, and of unseen licences over half."""
    import random

    model = licences.trained()
    held = [(c, model.probabilities(t)) for c, t, h in licences._examples(random.Random(licences.SEED)) if h]
    kinds = [c if c in (licences.NONE, licences.UNKNOWN) else "family" for c, _ in held]
    passed = {kind: np.mean([1 - p[-1] >= model.threshold for k, (_, p) in zip(kinds, held, strict=True) if k == kind]) for kind in set(kinds)}
    assert passed[licences.NONE] <= 0.02 and passed["family"] >= 0.95 and passed[licences.UNKNOWN] >= 0.5
    families = [(c, p) for c, p in held if c in licences.TEMPLATES and 1 - p[-1] >= model.threshold]
    assert np.mean([model.classes[p[:-1].argmax()] == c for c, p in families]) >= 0.85


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    byte, piece = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    for df in (simhash.near_duplicates(no_docs), simhash.one_of_each(no_docs), pieces.round_trip(no_docs, piece), packing.pack(no_docs, byte), recompress.digests(no_docs), quality.scored(no_docs, labels), licences.scan(no_docs)):
        assert df.collect() == []


def plain_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar_groups(rows):
    """For each row the place of the first row that it reaches over shingle similarities of 0.8 or more."""
    sets = [plain_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and (a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("hot", [256, 3])
def test_pipeline_keeps_one_of_each_similar_group(spark, texts, hot, monkeypatch):
    import random

    import corpus_pipeline

    monkeypatch.setattr(alike, "HOT", hot)
    rng = random.Random(8)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    for k in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((1000 + 10 * k, " ".join(w)))
        for n in range(1, 6):
            near = list(w)
            # Similarities of about 0.95 down to 0.75: both sides of the bound.
            for at in rng.sample(range(200), n):
                near[at] = f"x{rng.randrange(5000)}"
            rows.append((1000 + 10 * k + n, " ".join(near)))
    rows += [rows[5], (None, rows[9][1]), (None, "no id here but some five words"), (None, "no id here but some five words")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert kept.columns == df.columns
    least = {}
    for (d, _), g in zip(rows, similar_groups(rows), strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
        else:
            least.setdefault(g, float("inf"))
    want = sorted(str(d) if d < float("inf") else "None" for d in least.values())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


@pytest.mark.parametrize("width", [20, 40, 72, 80])
def test_wrapped_licences(spark, width):
    import textwrap

    notices = {
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    }
    rows = [(k, "Heading\n\n" + textwrap.fill(t, width) + "\n\nMore words.") for k, t in enumerate(notices.values())]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    for k, (family, text) in enumerate(notices.items()):
        found = [r for r in got if r["doc_id"] == k]
        assert (family, 2) in {(r["family"], r["paragraph"]) for r in found}
        assert {r["family"] for r in found} == {family}


def test_licence_names(spark):
    names = {"CC BY-SA 4.0": "cc-by-sa", "CC-BY 4.0": "cc-by", "Creative Commons Attribution 4.0": "cc-by", "Apache 2.0": "apache", "BSD-3-Clause": "bsd"}
    plain = ["An Apache helicopter landed near the village.", "Creative people commonly work at night."]
    df = spark.createDataFrame([(k, f"Some heading\n{t}\nLast line.") for k, t in enumerate([*names, *plain])], "doc_id long, text string")
    assert {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scan(df).collect()} == {(k, 1): f for k, f in enumerate(names.values())}


def test_windows_of_one_name_by_chance_are_told_apart():
    names, seconds, ids = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 2, 1], np.uint64), np.array([1, 2, 3, 4])
    assert recompress._repeated(names, seconds, ids).tolist() == [False, False, True, False]
    assert [x.tolist() for x in recompress._smallest(names, seconds, ids)] == [[7, 7, 9], [1, 2, 1], [1, 2, 4]]
    assert recompress._pairs_in(names, seconds, np.array([7, 7], np.uint64), np.array([0, 2], np.uint64)).tolist() == [False, True, True, False]


def test_the_pipeline_against_brute_force(spark, small):
    import corpus_pipeline

    documents = sorted(rows_of(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")))
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality").collect()]
    good = [row for row, score in zip(documents, plain_scores(documents, labels), strict=True) if score >= 0.5]
    first = {}
    for row, group in zip(good, similar_groups(good), strict=True):
        first.setdefault(group, row)
    single = sorted(first.values())
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {d: t or "" for d, t in single}
    want = {}
    for d, _, cut, kept in plain_removals(single):
        ids = np.array([*tokenizer.encode(kept if cut else texts[d], add_special_tokens=False).ids, 1], dtype="<u4")
        want[d] = ids.tobytes()
    assert len(documents) > len(good) > len(single) and any(cut for _, _, cut, _ in plain_removals(single))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    for d, pieces_of in got.items():
        at = 0
        for r in sorted(pieces_of, key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(want[d][4 * at : 4 * (at + r["length"])]) == r["ids_crc32"]
            at += r["length"]
        assert 4 * at == len(want[d])


def test_stages_keep_columns_of_any_name(spark, texts):
    """Names that the stages use themselves, with types of their own, and rows without an id."""
    import corpus_pipeline

    rows = [(k if k % 9 else None, t, "a", "b", 3, "c") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __same string, __first string, __block_ int, __block string").repartition(3)
    sorted_rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    plain = df.select("doc_id", "text")
    for stage in (simhash.one_of_each, lambda d: corpus_pipeline.keep_one_of_each(spark, d, ""), recompress.without_repeats):
        out = stage(df)
        assert out.columns == df.columns
        assert sorted_rows(out.select("doc_id", "text")) == sorted_rows(stage(plain))
        assert {tuple(r)[2:] for r in out.collect()} == {("a", "b", 3, "c")}


def test_ids_that_have_no_order_are_refused(spark):
    with pytest.raises(TypeError):
        recompress.digests(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_blocks_follow_the_input(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    few = recompress.Blocks(stored).n_blocks
    monkeypatch.setattr(recompress, "BLOCK_BYTES", 4096)
    many = recompress.Blocks(stored).n_blocks
    assert many > 2 * few and recompress.Blocks(docs.sparkSession.createDataFrame([(1, "a")], "doc_id long, text string")).n_blocks == few
    key = lambda d: sorted((tuple(r) for r in recompress.digests(d).collect()), key=str)
    got = key(stored)
    monkeypatch.undo()
    assert got == key(docs)


def test_one_place_has_no_contradictory_notices(spark):
    words = max(licences.TEMPLATES["mit"], key=len).split()
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    found = licences.scan(spark.createDataFrame([(1, f"Some prose.\n\n{wrapped}\n\nMore prose."), (2, wrapped)], "doc_id long, text string")).collect()
    for doc, first in ((1, 2), (2, 0)):
        assert [(r["family"], r["confirmed"]) for r in found if r["doc_id"] == doc and r["paragraph"] == first] == [("mit", True)]


def test_pipeline_groups_are_proposed_by_fingerprints(spark, monkeypatch):
    """What SimHash fingerprints link is compared by its shingles, were it in no band of MinHashes together."""
    import random

    import corpus_pipeline

    def nothing(batches):
        for _ in batches:
            pass
        return iter(())

    monkeypatch.setattr(alike, "_stars", nothing)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + near)], "doc_id long, text string").repartition(3)
    linked = {k for k in range(60) if (simhash.fingerprint(texts[k]) ^ simhash.fingerprint(near[k])).bit_count() <= 3}
    assert linked
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()}
    assert kept == set(range(120)) - {60 + k for k in linked}


def test_pipeline_searches_components_of_all_proposals_at_once(spark, monkeypatch):
    # Each search plans some rounds of jobs, which the driver holds.
    calls = []
    for module in (alike, simhash):
        monkeypatch.setattr(module, "components", lambda edges, found=module.components: calls.append(1) or found(edges))
    words = [f"w{k}" for k in range(40)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + " end"), (3, " ".join(words)), (4, "quite another text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in alike.one_of_each(df).collect()) == [1, 4]
    assert len(calls) == 2
