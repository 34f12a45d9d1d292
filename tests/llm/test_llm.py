"""The llm operators against brute force, the libraries and SQL, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import components, edit_embed, langid, licenses, merge_table, mixing, near_dup, quality, queries, substring, toxicity, words
from tests.compare import spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text and columns named like results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "x", None, "b"), (5, "same text here now ok yes", "en", "a"), (6, "same text here now ok yes", "en", "a"),
            (6, "same text here now ok yes", "en", "a"), (None, "no id", "fr", None), (7, long, "de", "b"), (8, "é😀漢 ▁x  y", "fr", "a")]
    return frame(spark, rows).select("*", *[F.lit("clash").alias(c) for c in ("n_tokens", "kept", "score", "size", "ranges", "component_id")])


def every_operator(spark):
    labels = frame(spark, [(5, 0), (6, 1), (8, None), (None, 1)], "doc_id long, toxic int")
    return {
        "op1": near_dup.near_duplicates, "op2": licenses.scan_licenses, "op3": langid.predict_languages, "op4": edit_embed.edited_pairs, "op4f": edit_embed.fingerprint, "op5": merge_table.token_counts,
        "op5b": lambda d: merge_table.token_budget(d, 3), "op6": quality.quality, "op7": lambda d: toxicity.toxicity(d, labels), "op8": mixing.mix, "op9": substring.dedup_substrings,
        "op10": merge_table.encode, "op10d": merge_table.encode_digests,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op4f", "op5", "op5b", "op6", "op7", "op8", "op9", "op10", "op10d"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = every_operator(spark)[name]
    got = run(odd).collect()
    if name != "op2":
        assert Counter(r["doc_id"] for r in got) == Counter([1, 2, 3, 4, 5, 6, 6, None, 7, 8])
    assert run(odd.limit(0)).count() == 0


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, FOLDER)) == sql_rows(queries.ORACLE_SQL[name], FOLDER)


@here
def test_parts_that_sql_can_express(spark):
    got = queries.QUERIES["op4_edit_fingerprints"](spark, FOLDER)
    assert spark_rows(got.select("doc_id", "n_chars", "edited_sha256")) == sql_rows(edit_embed.ORACLE_EDITED, FOLDER)
    got = queries.QUERIES["op6_quality_rules"](spark, FOLDER)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert spark_rows(got.select(*base)) == sql_rows(quality.ORACLE_BASE, FOLDER)


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=merge_table.default_model())


def test_encoding_is_the_librarys():
    sp, codec = library(), merge_table.Codec(merge_table.proto_of(None))
    rnd = random.Random(1)
    parts = [" ", "  ", "a", "b", "the", "▁", "é", "é", "\U0001f600", "\n", "\t", "<s>", "ing", "xxxxx", "漢字", "\0", "​", "1234", "!!!", "    ", "퟿", "tion", ".", ",", "\U0010fffd"]
    texts = ["", *("".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000))]
    mine = codec.encode(texts)
    for text, ids in zip(texts, mine, strict=True):
        assert sp.encode(text) == ids.tolist()
        assert codec.decode([1, *ids.tolist(), 2]) == sp.decode([1, *ids.tolist(), 2])
    assert codec.counts(texts).tolist() == [len(x) for x in mine]
    for ids in ([rnd.randrange(600) for _ in range(rnd.randint(0, 8))] for _ in range(500)):
        assert codec.decode(ids) == sp.decode(ids)
    for text, counts in zip(texts[:150], codec.prefix_counts(texts[:150]), strict=True):
        assert counts.tolist() == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]


def test_pair_compatibility_is_merging_back():
    model, rnd = merge_table.Codec(merge_table.proto_of(None)).model, random.Random(2)
    plain = [i for p, i in model.id_of.items() if model.merged(p)[0] == [p]]
    for a, b in ((rnd.choice(plain), rnd.choice(plain)) for _ in range(3000)):
        x, y = model.pieces[a], model.pieces[b]
        assert model.compatible(a, b) == (model.merged(x + y)[0] == [x, y])


def windows_by_brute_force(rows, width=20):
    first, out, split = {}, [], {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k : k + width]), (i, k))
    for i, w in split.items():
        gone = {x for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] != (i, k) for x in range(k, k + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("few", "hot"), [(False, 4 << 20), (True, 4 << 20), (False, 100), (True, 100)])
def test_substring_dedup(spark, monkeypatch, few, hot):
    """With small limits, minimisers' buckets are hot and their windows are dealt one by one."""
    monkeypatch.setattr(substring, "GATHER", 2000)
    monkeypatch.setattr(substring, "HOT_BYTES", hot)
    if hot == 100:
        monkeypatch.setattr(substring, "BUCKET_BYTES", 2000)
    rnd = random.Random(5 + few)
    vocabulary = ["a", "b", "é"] if few else [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60))] for _ in range(3)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.4 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        rows.append((i * 7 % 61, None if i == 3 else rnd.choice([" ", "\n", "\t "]).join(w)))
    got = substring.dedup_substrings(frame(spark, rows, "doc_id long, text string").repartition(3), digest=True)
    assert sorted(map(tuple, got.collect())) == windows_by_brute_force(rows)


def test_substring_dedup_with_many_buckets_in_few_parts(spark, monkeypatch):
    monkeypatch.setattr(substring, "GATHER", 4000)
    monkeypatch.setattr(substring, "HOT_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    monkeypatch.setattr(substring, "PARTS", 3, raising=False)
    rnd = random.Random(8)
    passages = [[f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(20, 60))] for _ in range(5)]
    rows = [(i, " ".join(sum(rnd.choices(passages, k=2), [f"v{rnd.randint(0, 90)}" for _ in range(30)]))) for i in range(50)]
    got = substring.dedup_substrings(frame(spark, rows, "doc_id long, text string").repartition(3), digest=True)
    assert sorted(map(tuple, got.collect())) == windows_by_brute_force(rows)


def test_rows_sent_do_not_follow_the_number_of_buckets(monkeypatch):
    """A task sends at most ``PARTS`` rows at a time, however many buckets a large input has; the receiver finds each bucket as it was, also from a file."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(2000)).encode() for _ in range(20)]
    texts.append(b"x " + texts[3])
    sender = substring.Sender(substring.Routes(20_000, 4096, [], 1), 20, 3)
    sent = []
    for low in (0, 10):
        sender.take(np.arange(low, low + 11), texts[low : low + 11])
        sent.append(list(sender.send()))
    assert max(map(len, sent)) <= 512
    parts = {}
    for part, blob in sent[0] + sent[1]:
        parts.setdefault(part, []).append(blob)
    assert max(len(b) for b in parts.values()) == 2
    results = []
    for held in (1 << 30, 0):
        monkeypatch.setattr(substring, "HELD", held)
        found = [substring.repeats(own, 20) for blobs in parts.values() for own in substring.by_bucket(blobs)]
        assert len(found) > 2000
        results.append(sorted((d, x) for f in found for d, low, high in zip(*map(np.ndarray.tolist, f), strict=True) for x in range(low, high - 19)))
    assert results[0] == results[1] == [(20, x) for x in range(1, 1982)]


def test_substring_dedup_of_rows_without_an_id_and_of_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage + " one"), (None, passage + " one"), (None, "two " + passage), (5, passage), (5, passage), (9, None)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(frame(spark, rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 30, 0): 2, (9, 0, 0): 1, (None, 31, 30): 3})


def components_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            c = len(sets[i] & sets[j])
            if i < j and c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rnd, rows = random.Random(3), []
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(120)]
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        kinds = [passage + [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randint(3, 20))], w, [rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 50))]]
        rows.append((i, None if i == 50 else " ".join(kinds[i % 4])))
    got = near_dup.near_duplicates(frame(spark, rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == components_by_brute_force(rows)


def test_near_duplicates_without_ids_and_of_hot_pivots(spark, monkeypatch):
    """Rows without a doc_id link as others do; a pivot meets its members in parts."""
    monkeypatch.setattr(near_dup, "PART", 3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 200, 10)]
    rows = [(None, texts[0]), (7, texts[1]), (None, " ".join(base[:100]) + " end"), *((20 + k, t) for k, t in enumerate(texts[2:])), (None, "only here now"), (None, "only here now")]
    got = near_dup.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"] > 150) == Counter([(None, 7, False), (7, 7, True), *((20 + k, 7, False) for k in range(18))])
    assert Counter((r["component_id"], r["kept"]) for r in got if r["n_shingles"] < 150) == Counter({(None, True): 3})


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    value = np.unique(rng.integers(1, 2**63, 4000, dtype=np.uint64))
    for share in (0.0, 0.5, 0.75, 1.0):
        common = int(2000 * 2 * share / (1 + share))
        a, b = value[:2000], np.concatenate([value[:common], value[2000 : 4000 - common]])
        rows = near_dup.registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((rows[0] == rows[1]).mean() - share) < 0.17
        n = np.array([float(len(a))])
        if share != 0.5:  # about five standard deviations below, which either answer suits
            assert near_dup.may_reach(rows[:1], rows[1:], n, np.array([float(len(b))]), 75)[0] == (share >= 0.75)


def test_components_of_a_long_path(spark):
    links = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["least"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_edit_embedding_follows_edits(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghij klmnop") for _ in range(4000))
    near = text[:1000] + "Q" + text[1000:2500] + text[2503:]
    far = "".join(rnd.choice("abcdefghij klmnop") for _ in range(4000))
    p = edit_embed.fingerprints([text, near, far, text, "", "a" * 50_000])
    assert (p[0] == p[3]).all() and (p[0] == edit_embed.fingerprints([text])[0]).all()
    assert edit_embed.likeness(p[:1], p[1:2])[0] > 0.9 > 0.1 > edit_embed.likeness(p[:1], p[2:3])[0]
    docs = frame(spark, [(1, text), (2, near), (3, far), (4, text)], "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in edit_embed.similar_pairs(edit_embed.fingerprint(docs)).collect()} == {(1, 2)}


def test_similar_fingerprints_share_a_band_or_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)

    def like(row, share):
        return np.where(rng.random(edit_embed.SAMPLES) < share, row, row % 255 + 1).astype(np.uint8)

    def pairs(rows, **more):
        prints = spark.createDataFrame([(k, 9, t) for k, t in enumerate(edit_embed.as_text(np.array(rows, np.uint8)))], "doc_id long, n_chars long, fingerprint string")
        return {(r["a"], r["b"]) for r in edit_embed.similar_pairs(prints, **more).collect()}

    rows = rng.integers(1, 256, (400, edit_embed.SAMPLES)).astype(np.uint8)
    rows[200:] = [like(x, 0.56) for x in rows[:200]]
    alike = {(k, k + 200) for k in range(200) if edit_embed.likeness(rows[k : k + 1], rows[k + 200 :][:1])[0] >= 0.5}
    got = pairs(rows)
    assert got <= alike and len(got) > 0.95 * len(alike) > 150
    for size in (1000, 2):  # one bucket, where 1 to 6 are alike and all are unlike 0, in one block and in several
        monkeypatch.setattr(edit_embed, "BLOCK", size)
        rows = rng.integers(1, 256, (7, edit_embed.SAMPLES)).astype(np.uint8)
        rows[2:] = [like(rows[1], 0.9) for _ in range(5)]
        rows[:, :8] = rows[0, :8]
        rows[1:, 8::8] = rng.integers(1, 256, (6, 15))  # no other band of 8 is shared
        joined = {0: 0} | {k: k for k in range(1, 7)}
        got = pairs(rows, bits=8)
        for a, b in sorted(got) * 7:
            joined[a] = joined[b] = min(joined[a], joined[b])
        assert [joined[k] for k in range(7)] == [0, 1, 1, 1, 1, 1, 1]


def test_equal_fingerprints_keep_their_members(spark):
    docs = frame(spark, [(4, "some text"), (1, "some text"), (None, "some text"), (2, "other words"), (5, ""), (6, None)], "doc_id long, text string")
    got = edit_embed.classes(edit_embed.fingerprint(docs)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter([(4, 1), (1, 1), (None, 1), (2, 2), (5, 5), (6, 6)])


def test_segments_are_maximal():
    scorer = toxicity.Scorer(np.zeros(0, np.int64), np.zeros((0, toxicity.FOLDS + 1)))
    rnd = np.random.default_rng(2)
    for _ in range(300):
        x = np.where(rnd.random(12) < 0.4, rnd.integers(1, 5, 12).astype(float), -rnd.integers(1, 6, 12) / 4)
        sums = np.concatenate([[0], np.cumsum(x)])

        def best(low, high, sums=sums):
            """Split at the greatest segment, again and again: the definition."""
            pairs = [(sums[b] - sums[a], a - b, -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1) if sums[b] > sums[a]]
            if not pairs:
                return []
            _, _, _, a, b = max(pairs)
            return best(low, a) + [(a, b)] + best(b, high)

        got = [(a, b) for a, b, _ in scorer.segments(x)]
        total = lambda spans, sums=sums: sorted(round(sums[b] - sums[a], 9) for a, b in spans)
        assert total(got) == total(best(0, 12))


def labelled(spark, n=600):
    rnd, docs, labels = random.Random(9), [], []
    for i in range(n):
        w = [rnd.choice("one two three four five six seven eight nine ten".split()) + rnd.choice("abcdefg") for _ in range(rnd.randint(20, 80))]
        toxic = i % 5 == 2
        if toxic:
            for _ in range(6):
                w[rnd.randrange(len(w))] = rnd.choice(["idiotic", "scum", "moron"])
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(toxic)))
    return frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in held)
    assert all(r["segments"] for r in held if r["toxic"])


def test_labels_of_one_kind_give_a_constant(spark):
    docs, labels = labelled(spark, 30)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0.0}


@here
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = frame(spark, [(i, "abc def", "xx", "s") for i in range(30)])
    import zlib

    held = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1]
    only = docs.filter(F.col("doc_id").isin(held))
    assert {r["lang_pred"] for r in langid.predict_languages(only).collect()} == {"und"}


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    changed = mit.replace("without restriction", "with no restriction at all")
    rows = [(1, f"Intro words.\n{mit}\nMore."), (2, changed), (3, "Permission is hereby given to go."), (4, "x Licensed under CC BY-NC 4.0. y"), (5, None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1]["license"], got[1]["coverage"]) == ("MIT", 1.0)
    assert rows[0][1][got[1]["first_char"] : got[1]["past_char"]] == mit.rstrip(".")
    assert 0.9 < got[2]["coverage"] < 1
    assert got[4]["license"] == "CC-BY-NC-4.0"


def test_licenses_back_to_back_and_behind_comment_words(spark):
    notice, mit = "Released under the MIT License.", licenses.TEMPLATES["MIT"][1]
    words = mit.split()
    lines = [f"{mark} " + " ".join(words[k : k + 8]) for k, mark in zip(range(0, len(words), 8), ["REM"] * 99, strict=False)]
    rows = [(1, " ".join([notice] * 40)), (2, "\n".join(lines)), (3, f"é {notice} and {notice}"), (4, "\n".join(lines * 3)), (5, "Released under the MIT. " + notice), (6, f"{mit}\n{mit}")]
    got = licenses.scan_licenses(frame(spark, rows, "doc_id long, text string")).orderBy("doc_id", "first_char").collect()
    assert Counter(r["doc_id"] for r in got) == {1: 40, 2: 1, 3: 2, 4: 3, 5: 2, 6: 2}
    assert all(r["license"] == "MIT" for r in got)
    assert [(r["first_char"], r["past_char"]) for r in got if r["doc_id"] == 1] == [(k * 32, k * 32 + 30) for k in range(40)]
    assert all(r["coverage"] == 1 for r in got if r["doc_id"] not in (5,))
    text = dict(rows)
    assert all(text[r["doc_id"]][r["first_char"] : r["past_char"]].startswith(("Released", "Permission")) for r in got)
    assert [round(r["coverage"], 1) for r in got if r["doc_id"] == 5] == [0.8, 1.0]


def test_edited_licenses_and_tags_are_found(spark):
    rnd, rows, planted = random.Random(12), [], {}
    for name, variants in licenses.TEMPLATES.items():
        for text in variants:
            words = text.split()
            if len(words) < 20:
                continue
            for k in rnd.sample(range(len(words)), len(words) // 20):
                words[k] = rnd.choice(["", "other", words[k] + " more"])
            planted[len(rows)] = name
            rows.append((len(rows), "before it " + " ".join(words) + " after it"))
    tags = {len(rows) + k: n for k, n in enumerate(licenses.TEMPLATES)}
    rows += [(k, f"// {licenses.tag(n)}\nint x;") for k, n in tags.items()] + [(999, "SPDX-License-Identifier: Apache-1.1")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(frame(spark, rows, "doc_id long, text string")).collect()}
    assert sum((k, n) in got for k, n in planted.items()) >= 0.9 * len(planted)
    assert all((k, n) in got for k, n in tags.items()) and not any(k == 999 for k, _ in got)


@here
def test_token_counts_and_digests_are_the_librarys(spark):
    sp, docs = library(), {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    counts = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op5_token_counts"](spark, FOLDER).collect()}
    digests = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op10_sentencepiece"](spark, FOLDER).collect()}
    assert set(counts) == set(digests) == set(docs)
    for k, text in docs.items():
        ids = sp.encode(text)
        assert counts[k] == (len(text.encode()), len(ids), len(ids) > 4096)
        both = [sp.bos_id(), *ids, sp.eos_id()]
        assert digests[k] == (len(both), hashlib.sha256(np.array(both, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(both).encode()).hexdigest())


def test_another_kind_of_model_is_an_error():
    import public_tokenizers

    other = [p for p in (public_tokenizers.path(n) for n in os.listdir(os.path.dirname(public_tokenizers.__file__)) if n.endswith(".model")) if p != merge_table.default_model()]
    for path in other:
        try:
            model = merge_table.Model(merge_table.proto_of(path))
        except ValueError:
            continue
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        assert all(merge_table.Codec(model).encode([t])[0].tolist() == sp.encode(t) for t in merge_table.PROBES)


@here
def test_verdicts_of_quality_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    codec, rows = merge_table.Codec(merge_table.proto_of(None)), quality.quality(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    groups, group_of = {}, {}
    for r in rows:
        group = group_of[r["doc_id"]] = (langs[r["doc_id"]], int(np.log2(max(len(codec.encode([texts[r["doc_id"]]])[0]), 1)) // 2))
        if not r["base_failed"]:
            groups.setdefault(group, []).append(r)
    for r in rows:
        group = group_of[r["doc_id"]]
        held = groups.get(group, [])
        inside = True
        for m in quality.METRICS if held else ():
            values = sorted(round(x[m] + 1e-12, quality.DIGITS) for x in held)
            low, high = (values[int(np.ceil(len(values) * q)) - 1] for q in (0.25, 0.75))
            width = (quality.SPREAD * (high - low) + quality.SLACK[m] / 2 ** group[1]) * (1 + quality.FEW / len(values) ** 0.5)
            inside = inside and low - width - 1e-6 <= r[m] <= high + width + 1e-6
        assert r["kept"] == (not r["base_failed"] and inside)


def test_mix_comes_near_its_targets(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.randint(1, 60)), None, rnd.choice(["big"] * 20 + ["small", None])) for i in range(500)]
    got = mixing.mix(frame(spark, rows), block=64).collect()
    taken, target, own = Counter(), {}, {}
    for r in got:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        target[key] = own[key] = r["target"]
    assert all(abs(n - k[1]) <= 1 for k, n in taken.items())
    slots = mixing.schedule(mixing.targets(mixing.sized(frame(spark, rows))), 64).collect()
    assert len({s["slot"] for s in slots}) == len(slots)
    order, whole = Counter(), Counter(s["number"] for s in slots)
    bound = len(slots).bit_length() + 1
    for n, s in enumerate(sorted(slots, key=lambda s: s["slot"])):  # ranks rise with the schedule within a source
        assert s["rank"] == order[s["number"]]
        order[s["number"]] += 1
        for source, of in whole.items():  # every prefix of the schedule holds each source close to its share
            assert abs(order[source] - (n + 1) * of / len(slots)) <= bound
    assert bound < len(slots) / 10


def test_mix_as_documents_comes_in_schedule_order(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 60)), None, rnd.choice(["big"] * 9 + ["small"])) for i in range(300)] + [(None, None, None, None), (None, "no id here", None, None), (7000, "same row", None, "big"), (7000, "same row", None, "big")]
    docs = frame(spark, rows)
    found = mixing.mix(docs, block=64).collect()
    times = Counter()
    for r in found:
        assert len(r["slots"]) <= 3 and (r["taken"] > 0) == (r["first_slot"] is not None)
        times[r["doc_id"]] += len(r["slots"])
    out = [r["doc_id"] for r in mixing.in_schedule_order(docs, block=64).collect()]
    assert Counter(out) == +times
    expected = sorted((slot, r["doc_id"]) for r in found if r["doc_id"] != 7000 for slot in r["slots"])
    at = {}
    for place, (slot, doc) in enumerate(expected):
        at.setdefault(slot, set()).add(doc)
    seen = [d for d in out if d != 7000]
    for slot in sorted(at):  # documents of one slot in any order
        here, seen = seen[: sum(1 for s, _ in expected if s == slot)], seen[sum(1 for s, _ in expected if s == slot) :]
        assert set(here) == at[slot]
    words = Counter()
    for r in found:
        words[r["source_size"], r["target"]] += len(r["slots"]) * r["size"]
    assert all(abs(n - target) <= 60 for (_, target), n in words.items())


def test_repeated_words_and_fertility():
    texts = [b"a b c d e f g h x a b c d e f g h", b"", b"a b c"]
    n, chars, repeated = quality.repeated_words(texts)
    assert (n.tolist(), chars.tolist(), repeated.tolist()) == ([17, 0, 3], [17, 0, 3], [16, 0, 0])
    codec = merge_table.Codec(merge_table.proto_of(None))
    tokens, per, share, entropy = quality.fertility(codec, ["plain words here", "", ""])
    assert share[0] == 0 and share[1] > 0.5 and tokens[2] == 0


def test_words_split_as_bytes_do():
    texts = ["a\x0bb\x1fc d e", "", " x "]
    _, starts, ends, begins = words.compact([t.encode() for t in texts])
    assert np.diff(begins).tolist() == [len(t.encode().split()) for t in texts]


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as C

    frame(spark, [(5, 0), (6, 1), (8, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("copy", F.lit("clash"))
    for rows in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            assert name == "sentencepiece" or rows.columns == list(C.COLUMNS)
            ids = [r["doc_id"] for r in rows.collect()]
            assert not ids or (None in ids and 7 in ids)


@here
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    columns = list(C.COLUMNS)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = docs.collect()
        if name == "near_dedup":
            expected = {i for i, _, _, kept in components_by_brute_force(list(before.items())) if kept}
            assert {r["doc_id"] for r in after} == expected
        if name == "substring_dedup":
            gone = {i: (n, digest) for i, _, n, digest in windows_by_brute_force(list(before.items()))}
            for r in after:
                n, digest = gone[r["doc_id"]]
                assert r["text"] == before[r["doc_id"]] if n == 0 else hashlib.sha256(r["text"].encode()).hexdigest() == digest
    last = C.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)
