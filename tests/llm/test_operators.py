"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from pricetide.llm import byte_bpe, chat_prefixes, factorisation, jaccard_join, license_notices, line_frequency, log_bilinear, spaced_seeds, url_vocabulary, warc_segments

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept boolean, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}{chr(97 + draw.randrange(26))}" for _ in range(n))


def docs_of(spark, rows):
    """Documents from (id, text, source), with columns named like results."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, "k", False, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (None, prose(1, 60), "a"), (5, prose(2, 3), "b"), (6, prose(3, 30_000), "b"), (7, prose(4, 80), "a"), (7, prose(4, 80), "a"), (8, prose(4, 80), "a"),
            (9, prose(5, 70) + " é漢😀 \x85x", None)]
    return rows, docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# --- byte-level BPE


def test_bpe_equals_tiktoken_and_round_trips(odd, none):
    rows, docs = odd
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})
    got = byte_bpe.round_trip(docs).collect()
    want = []
    for i, text, _ in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert collections.Counter(tuple(r)[:4] for r in got) == collections.Counter(want)
    assert all(r["exact"] for r in got)
    assert byte_bpe.round_trip(none).count() == byte_bpe.encode(none).count() == 0


def test_bpe_words_between_blanks():
    codec = byte_bpe.codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})
    draw, signs = random.Random(3), [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "!", " ", "\x1c", "漢", "😀", "\x85", " \n", "​", "it's"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(14))) for _ in range(20_000)]
    assert [g.tolist() for g in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_offsets_and_split_characters(spark):
    text = "naïve 漢字 😀😀 end"
    row = byte_bpe.encode(docs_of(spark, [(1, text, "a")])).first()
    codec = byte_bpe.codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert all(codec.token_bytes[t] in text[s:e].encode() for t, s, e in zip(row["token_ids"], row["starts"], row["ends"], strict=True))
    assert "".join(codec.decode_pieces([[t] for t in row["token_ids"]])) == text
    assert any(s < e0 for s, e0 in zip(row["starts"][1:], row["ends"], strict=False))  # a character in two tokens
    back = byte_bpe.decode(byte_bpe.encode(docs_of(spark, [(1, text, "a"), (2, None, "a")]))).orderBy("doc_id").collect()
    assert [r["decoded_text"] for r in back] == [text, ""]


# --- quality classifier


def test_machine_pairs_in_linear_time():
    draw = np.random.default_rng(0)
    size = factorisation.BUCKETS + factorisation.N_STATS
    machine = factorisation.Machine(0.3, draw.normal(size=size), draw.normal(size=(size, 3)), np.zeros(factorisation.N_STATS), np.ones(factorisation.N_STATS))
    stats, buckets, values = draw.uniform(size=(1, factorisation.N_STATS)), np.array([3, 8, 9]), np.array([0.5, 1.0, 0.25])
    got = machine.margins(stats, np.array([0, 3]), buckets, values)[0]
    at, x = [*buckets, *range(factorisation.BUCKETS, size)], [*values, *stats[0]]
    want = machine.bias + sum(machine.weights[i] * v for i, v in zip(at, x, strict=True))
    want += sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_classifier(spark, odd, none):
    good = [(100 + i, prose(i, 90), "a") for i in range(60)]
    bad = [(200 + i, "BUY NOW!! $$$ ### " * 20 + prose(i, 5), "a") for i in range(60)]
    docs = docs_of(spark, good + bad + odd[0])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _, _ in good + bad] + [(None, 1, 0), (100, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = factorisation.classify(docs, labels).collect()
    assert len(rows) == len(good + bad + odd[0])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] >= 100]
    assert sum(r["predicted"] == (r["doc_id"] < 200) for r in tested) >= 0.95 * len(tested)
    assert len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert {r["score"] for r in factorisation.classify(odd[1], labels.limit(0)).collect()} == {0.5}
    assert factorisation.classify(none, labels).count() == 0
    odd_columns = docs.withColumn("label", F.lit("own")).withColumn("label_id", F.lit(-1)).withColumn("a.b", F.lit("dot")).withColumn("__score", F.lit("mine"))
    kept = factorisation.filter_documents(odd_columns, labels)
    assert kept.columns == odd_columns.columns and {(r["label"], r["label_id"], r["a.b"], r["__score"], r["score"]) for r in kept.collect()} == {("own", -1, "dot", "mine", 0.5)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["predicted"])


def test_sample_bound_holds_for_repeated_ids(spark):
    docs = docs_of(spark, [(1, prose(1, 20), "a")] * 300 + [(1, prose(k, 9), "a") for k in range(50)] + [(2, prose(2, 30), "a")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = factorisation.training_rows(docs, labels, 100, 4, 5).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 51, 2: 1}
    assert len(factorisation.training_rows(docs, labels, 20, 4, 5).collect()) == 20


# --- quality rules


def test_line_rules(spark, odd, none):
    rows, docs = odd
    got = line_frequency.quality_report(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[1]["kept"] and not by_id[2]["kept"] and by_id[3]["n_words"] == 0 and by_id[7]["kept"]
    assert line_frequency.quality_report(none).count() == line_frequency.filter_documents(none).count() == 0
    assert line_frequency.filter_documents(docs).columns == docs.columns


def test_frequent_lines_go_and_copies_count_once(spark):
    menu = "Home News  Contact " + prose(99, 5)
    pages = [(i, f"{menu}\n{prose(i, 60)}\n{menu}", "h") for i in range(12)]
    copies = [(100 + i, prose(500, 60) + "\n" + prose(501, 60), "h") for i in range(30)]
    poor = [(200, menu + "\n" + "\n".join([menu] * 7), "h"), (201, f"{menu}\n{prose(7, 60)}", "other")]
    docs = docs_of(spark, pages + copies + poor)
    report = {r["doc_id"]: r for r in line_frequency.quality_report(docs).collect()}
    assert all(report[i]["kept"] and report[i]["n_removed_words"] == 16 for i in range(12))
    assert all(report[i]["kept"] and report[i]["n_removed_words"] == 0 for i in range(100, 130))
    assert not report[200]["kept"] and report[201]["n_removed_words"] == 0
    clean = {r["doc_id"]: r for r in line_frequency.filter_documents(docs).collect()}
    assert clean[3]["text"] == prose(3, 60) and clean[3]["n_chars"] == len(clean[3]["text"]) and clean[101]["text"] == copies[1][1] and 200 not in clean


def test_a_line_in_fifty_documents_goes_on_a_large_host_too(spark):
    rows = [(i, f"{prose(i, 60)}\nShare this page now" if i < 50 else prose(i, 60), "hot") for i in range(6000)]
    docs = docs_of(spark, rows + [(9000 + i, f"{prose(9000 + i, 60)}\nShare this page now", "small") for i in range(5)])
    report = {r["doc_id"]: r["n_removed_words"] for r in line_frequency.quality_report(docs).collect()}
    assert all(n == (4 if i < 50 else 0) for i, n in report.items())
    clean = {r["doc_id"]: r["text"] for r in line_frequency.filter_documents(docs).collect()}
    assert {i for i, text in clean.items() if "Share" in text} == set(range(9000, 9005))


def test_line_rules_reject_depleted(spark):
    menu = [prose(900 + k, 40) for k in range(3)]
    docs = docs_of(spark, [(i, "\n".join(menu) + "\n" + prose(i, 30 if i < 10 else 300), "h") for i in range(20)])
    report = {r["doc_id"]: r["kept"] for r in line_frequency.quality_report(docs).collect()}
    assert report == {i: i >= 10 for i in range(20)}


# --- language model


def test_language_model(spark, odd, none):
    rows = odd[0] + [(1000 + i, " ".join(random.Random(i).choice(["the cat sat", "a dog ran", "THE bird flew"]) for _ in range(40)), "a") for i in range(60)]
    got = log_bilinear.score_texts(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + [None]
    counts = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    tested = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert tested and sum(r["score"] for r in tested) > 0.9 * sum(r["base_score"] for r in tested)
    assert log_bilinear.score_texts(none).count() == 0


def test_language_model_is_normalised():
    draw = np.random.default_rng(1)
    words = draw.integers(-(2**62), 2**62, 3000)
    counts = np.sort(draw.integers(1, 500, 3000))[::-1].astype(float)
    vocabulary = log_bilinear.Vocabulary(words[:1000], counts[:1000], int(counts.sum()), 3000)
    assert np.array_equal(vocabulary.find(words), np.where(np.arange(3000) < 1000, np.arange(3000), -1))
    model = log_bilinear.Model.fresh(vocabulary.mass / vocabulary.mass.sum())
    classes = 10.0 ** model.log_probabilities(np.array([3, 256]), np.array([7, 256]))
    assert np.allclose(classes.sum(axis=1), 1, atol=1e-5)
    rare = (counts[1000:] + 0.5).sum() + 0.5  # and the unseen word
    assert math.isclose(rare, vocabulary.mass[log_bilinear.RARE_CLASS], rel_tol=1e-9)
    for k in set(vocabulary.classes):
        assert math.isclose((10 ** vocabulary.within[vocabulary.classes == k]).sum(), 1, rel_tol=1e-9) or k == log_bilinear.RARE_CLASS


# --- URL filter


def test_urls(spark):
    urls = {1: None, 2: "", 3: "no scheme", 4: "http://A.NET/x", 5: "https://example.net/en/a", 6: "http://example.net", 7: "http://q.example.com/de/1", 8: "http://xorg/fr/", 9: "http://x.org/fr/casino",
            10: "http://ok.example.com/casino", 11: "http://ok.example.com/casinos", 12: "http://cheap-pills.example.com/", 13: "http://cheap.example.com/", 14: "http://a.com/free/win?x=1", 15: "http://a.com/free"}
    pages = spark.createDataFrame([(i, u, "block") for i, u in urls.items()], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_vocabulary.judge_urls(pages).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "/x", "net/", "block") and got[5][2:] == ("example.net/en/", "allow") and got[6] == ("example.net", "", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2] is None and got[9][2:] == ("org/fr/", "allow")
    assert [got[i][3] for i in range(10, 16)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert url_vocabulary.judge_urls(pages.limit(0)).count() == 0


# --- license scan


def test_licenses(spark, odd, none):
    texts = {1: "Released under the MIT License.", 2: "Licensed undr the Apachee License, Version 2.0", 3: "x gnu general public license apache license\nMIT license", 4: None, 5: "", 6: "licensed under cc by-nc 4.0 and CC BY",
             7: "the apache helicopter", 8: prose(1, 20_000) + " Permission is hereby grantd, free of charge, to any person obtainning a copy "}
    got = {r["doc_id"]: r for r in license_notices.scan_licenses(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (1, 3, "mit", 1.0)
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "apache" and 0.9 < got[2]["score"] < 1 and got[2]["notices"][0]["edits"] == 2
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (3, 1, 7, "apache,gpl,mit")
    assert [(got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["labels"], got[i]["score"]) for i in (4, 5)] == [(0, 0, None, "", 0.0)] * 2
    assert got[6]["labels"] == "cc-by,cc-by-nc" and got[6]["n_base"] == 2 and got[7]["labels"] == ""
    assert got[8]["labels"] == "mit" and got[8]["notices"][0]["edits"] == 2 and got[8]["notices"][0]["word"] == 20_000
    assert license_notices.scan_licenses(odd[1]).count() == len(odd[0]) and license_notices.scan_licenses(none).count() == 0


def test_notices_close_together_and_a_scan_of_all_places(spark):
    """Of notices in a row each is found; against the best match from every place of random texts."""
    texts = ["relesed undr the mit license released under the mit license", "released under the mit license " * 3 + "relesed under the mit licens"]
    found = {r["doc_id"]: [(n["word"], n["edits"]) for n in r["notices"]] for r in license_notices.scan_licenses(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert found == {0: [(0, 2), (5, 0)], 1: [(0, 0), (5, 0), (10, 0), (15, 2)]}
    draw, notice = random.Random(5), "released under the mit license"
    k = license_notices.edits_of(notice, license_notices.CHARS_PER_EDIT)
    whole = regex.compile(rf"(?b)(?:{notice}){{e<={k}}}")
    for _ in range(60):
        words = prose(draw.randrange(999), 8).split()
        for _ in range(3):
            chars = list(notice)
            for _ in range(draw.randrange(k + 3)):
                at = draw.randrange(len(chars))
                chars[at : at + 1] = draw.choice([[], ["x"], [chars[at], "y"]])
            words.insert(draw.randrange(len(words) + 1), "".join(chars))
        text = " ".join(words)
        _, _, got = license_notices.scan_text(text.encode(), (), ((notice, "mit"),), license_notices.CHARS_PER_EDIT)
        words = text.split()
        scanned = {(a, b - a): sum(m.fuzzy_counts) for a in range(len(words)) for b in range(a + 1, min(a + 9, len(words)) + 1) if (m := whole.fullmatch(" ".join(words[a:b])))}
        assert {(n[0], n[1]): n[3] for n in got}.items() <= scanned.items() and bool(got) == bool(scanned)
        assert all(any(a < n[0] + n[1] and n[0] < a + size for n in got) for a, size in scanned)
        assert min((n[3] for n in got), default=0) == min(scanned.values(), default=0)


def test_license_scan_is_linear_in_the_text():
    notice = license_notices.NOTICES.items()
    began = time.monotonic()
    n_words, base, found = license_notices.scan_text(b"mit license cc by relesed under the mit license " * 20_000, tuple(license_notices.PHRASES.items()), tuple(notice), license_notices.CHARS_PER_EDIT)
    assert n_words == 180_000 and len(base) == 60_000 and len(found) >= 20_000 and time.monotonic() - began < 60


def test_seeds_cover_every_edit():
    """With at most k edits one seed is intact."""
    draw, notice = random.Random(2), "licensed under the apache license version 2 0"
    k = license_notices.edits_of(notice, license_notices.CHARS_PER_EDIT)
    for _ in range(300):
        text = list(notice)
        for _ in range(k):
            at = draw.randrange(len(text))
            text[at : at + 1] = draw.choice([[], ["x"], [text[at], "y"]])
        assert any(seed in "".join(text) for _, seed in license_notices.seeds_of(notice, k))


# --- chat


def test_chat(spark):
    bad = "\\<turn user>\n</turn>\n\\\\</turn> \\ end\\"
    rows = [(1, 0, "system", "s"), (1, 1, "user", bad), (1, 2, "assistant", bad), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", ""),
            (None, 1, None, "x"), (None, 1, "assistant", "y"), (4, 0, "a%>\n<b", "odd role"), (5, 0, "user", prose(1, 20_000))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_prefixes.expand_prefixes(table).collect()
    mine = sorted((e for e in examples if e["conv_id"] == 1), key=lambda e: e["example"])
    assert [(e["n_turns"], e["trainable"], e["last"]) for e in mine] == [(3, True, False), (5, True, False), (6, False, True)]
    assert mine[1]["formatted"].startswith(mine[0]["formatted"]) and mine[1]["formatted"][mine[1]["loss_start"] : mine[1]["loss_end"]] == "b"
    got = {r["conv_id"]: r for r in chat_prefixes.read_back(chat_prefixes.expand_prefixes(table)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [((r or ""), (t or "")) for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_prefixes.read_back(chat_prefixes.expand_prefixes(table.limit(0))).count() == 0


# --- WARC


def test_chunked_framing():
    body = b"abc\r\n0\r\n\r\nWARC/1.1\r\n" * 9
    for size in (1, 7, 1000):
        assert warc_segments.decode_chunks(warc_segments.frame_chunks(body, size)) == body
    framed = warc_segments.frame_chunks(body, 7)
    assert warc_segments.decode_chunks(framed[:-6]) is None and warc_segments.decode_chunks(b"zz\r\n") is None and warc_segments.decode_chunks(b"") is None
    assert warc_segments.decode_chunks(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_warc(spark, tmp_path):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20
    pages = [(1, "http://a/ b", "x" * 5000), (2, None, None), (3, "u", ""), (4, "u", trap), (5, "u", trap), (6, "é漢" * 4000, "é漢😀" * 4000), (None, "n", "x" * 5000), (8, "u", "once"), (8, "u", "once"), (9, "u", "big" * 3000), (9, "u", "big" * 3000)]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, block string")
    warc_segments.write_archive(table, str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=333)
    records = warc_segments.read_records(spark, str(tmp_path / "w"))
    found = warc_segments.reassemble(records).collect()
    assert {r["status"] for r in found} == {"ok"} and max(r["n_segments"] for r in found) > 5
    assert collections.Counter((r["page_id"], bytes(r["payload"])) for r in found) == collections.Counter([(i, (h or "").encode()) for i, _, h in pages if i not in (None, 3, 5)])
    visits = {r["page_id"]: (r["response_id"], r["payload_bytes"]) for r in warc_segments.resolve_revisits(records, warc_segments.reassemble(records)).collect()}
    assert visits == {3: (2, 0), 5: (4, len(trap)), None: (1, 5000)}
    lost = records.where("segment is null or segment <> 2")
    assert {r["status"] for r in warc_segments.reassemble(lost).collect()} == {"ok", "incomplete"}
    broken = records.withColumn("block", F.when(F.col("segment") == 2, F.lit(b"short")).otherwise(F.col("block")))
    assert "length" in {r["status"] for r in warc_segments.reassemble(broken).collect()}
    files = []
    for name, rows in (("a", [p for p in pages if p[0] != 4]), ("b", [p for p in pages if p[0] == 4])):
        warc_segments.write_archive(spark.createDataFrame([(*p, "z") for p in rows], table.schema).coalesce(1), str(tmp_path / name), segment_bytes=10_000_000)
        files += [gzip.decompress(f.read_bytes()) for f in (tmp_path / name).glob("*.gz")]
    files = [f for f in files if f]
    (tmp_path / "cut").mkdir()
    for k, data in enumerate([f[:-200] for f in files] + [files[0], files[0][: files[0].index(b"WARC-Record-ID")]]):
        (tmp_path / "cut" / f"{k}.warc.gz").write_bytes(gzip.compress(data))
    cut = warc_segments.read_records(spark, str(tmp_path / "cut")).coalesce(1)
    assert cut.where("missing > 0").count() == len(files) + 1
    seen = collections.Counter((r["status"], r["payload"] is None) for r in warc_segments.reassemble(cut).collect())
    visits = cut.where("missing > 0 and type = 'revisit'").count()  # a revisit has no payload to lose
    assert seen["incomplete", True] == len(files) + 1 - visits > 0 and set(seen) == {("ok", False), ("incomplete", True)}
    warc_segments.write_archive(table.limit(0), str(tmp_path / "e"))
    assert warc_segments.read_records(spark, str(tmp_path / "e")).count() == 0


# --- decontamination


def test_spaced_seeds(spark, odd, none):
    item = prose(77, 40, 5000).split()
    swapped = list(item)
    for k in (5, 11, 18, 26, 33):
        swapped[k] = "changed"
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, "alpha beta gamma delta epsilon zeta eta", "x"), (3, "too short", "x"), (4, None, "x"), (5, "", "x")], "item_id long, text string, doc_id string")
    around = lambda seed, words: prose(seed, 50) + " " + " ".join(words) + " " + prose(seed + 1, 50)
    rows = odd[0] + [(10, around(10, item), "a"), (11, around(20, swapped), "a"), (12, around(30, [w.upper() + "," for w in item]), "a"), (13, around(40, item[:20]), "a"), (14, around(50, item[:6]), "a"),
                     (15, "x Alpha beta gamma, delta epsilon zeta eta y", "a"), (16, "alpha beta gamma changed epsilon zeta eta too short", "a"), (17, around(60, item) + around(70, item), "a"), (None, around(80, item), "a"), (10, around(10, item), "a")]
    docs = docs_of(spark, rows)
    found = {(r["doc_id"], tuple(r["item_ids"])) for r in spaced_seeds.contaminated_documents(docs, bench).collect()}
    assert found == {(10, (1,)), (11, (1,)), (12, (1,)), (13, (1,)), (15, (2,)), (16, (2,)), (17, (1,)), (None, (1,))}
    kept = spaced_seeds.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(i) for i, _, _ in odd[0]] + ["14"])
    assert spaced_seeds.contaminated_documents(none, bench).count() == 0 and spaced_seeds.contaminated_documents(docs, bench.limit(0)).count() == 0


def test_masks_meet_every_accepted_run():
    masks = [sum(1 << i for i in spaced_seeds.mask_offsets(m)) for m in spaced_seeds.MASKS]
    for n, edits in ((12, 2), (15, 3), (20, 4)):
        for places in itertools.combinations(range(n), edits):
            changed = sum(1 << k for k in places)
            assert any(not changed & (m << s) for m in masks for s in range(n - m.bit_length() + 1)), (n, places)
    short = [sum(1 << i for i in spaced_seeds.mask_offsets(m)) for m in spaced_seeds.SHORT_MASKS]
    for n in range(spaced_seeds.SHORT_TOKENS, 12):
        for places in itertools.combinations(range(n), n // 5):
            changed = sum(1 << k for k in places)
            assert any(not changed & (m << s) for m in short for s in range(n - m.bit_length() + 1)), (n, places)


def test_overlaps_against_a_scan_of_all_diagonals(spark):
    draw = random.Random(8)
    items = [(i, prose(3000 + i, 12 + i % 13, 5000).split()) for i in range(26)] + [(99, prose(3999, 60, 5000).split())]
    items += [(200 + n, prose(4200 + n, n, 5000).split()) for n in range(6, 12)]
    rows = []
    for i, item in items:
        for edits in [set(range(4, len(item), 5))] + [set(draw.sample(range(len(item)), len(item) // 5 + extra)) for extra in (0, 0, 0, 1)]:
            rows.append((len(rows), " ".join([prose(len(rows), 8), *(f"z{k}" if k in edits else w for k, w in enumerate(item)), prose(len(rows) + 500, 8)]), "a"))
    rows += [(1000 + k, " ".join(f"z{j}" if j in places else w for j, w in enumerate(items[0][1])), "a") for k, places in enumerate(itertools.combinations(range(1, 11), 2))]
    for _, item in items[-6:]:
        for size in (1, 2, 3):
            rows += [(len(rows) + 2000, " ".join(["lead", *(f"z{j}" if j in places else w for j, w in enumerate(item)), "tail"]), "a") for places in itertools.combinations(range(len(item)), size)]
    want = set()
    for d, text, _ in rows:
        tokens = text.split()
        for i, item in items:
            if any(5 * sum(x == y for x, y in zip(item, tokens[d0:], strict=False)) >= 4 * len(item) for d0 in range(len(tokens) - len(item) + 1)):
                want.add((d, i))
            for diagonal in range(-len(item) + 12, len(tokens) - 11):
                equal = np.array([item[k] == tokens[k + diagonal] for k in range(max(0, -diagonal), min(len(item), len(tokens) - diagonal))])
                hits = np.flatnonzero(equal)
                if any(5 * equal[a : b + 1].sum() >= 4 * (b + 1 - a) for a in hits for b in hits if b + 1 - a >= 12):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.find_overlaps(docs_of(spark, rows), bench).collect()}
    assert len(want) > 100 and found == want


def test_best_run_against_all_runs():
    draw = np.random.default_rng(4)
    for _ in range(300):
        equal = draw.random(draw.integers(0, 25)) < 0.6
        hits = np.flatnonzero(equal)
        runs = [b + 1 - a for a in hits for b in hits if a <= b and equal[a : b + 1].mean() >= 0.8 - 1e-9]
        a, b = spaced_seeds.best_run(equal, 0.8)
        assert b - a == max(runs, default=0) and (a == b or equal[a:b].mean() >= 0.8 - 1e-9)


# --- Jaccard join


def shingle_sets(rows):
    out = []
    for i, text, _ in rows:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
        out.append((i, {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()))
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, sets, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), least.get(g) if s else i) for g, (i, s) in zip(group, sets, strict=True)]


def edited(seed, text, edits):
    draw, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, odd, none, seed):
    draw = random.Random(seed)
    passage = prose(1234, 46)
    rows = [(i, t, s) for i, t, s in odd[0] if i != 6]
    for g in range(8):  # near copies with few to many edits
        base = prose(seed * 100 + g, draw.randrange(20, 150))
        rows += [(100 + 20 * g + k, edited(k, base, draw.randrange(0, 8)), "a") for k in range(12)]
    rows += [(1000 + k, passage + " " + prose(seed * 7 + k, draw.randrange(0, 60)) if k else passage, "a") for k in range(60)]  # a common passage
    rows += [(2000 + k, prose(k % 5, draw.randrange(1, 8)), "a") for k in range(30)]
    got = jaccard_join.link_documents(docs_of(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(brute_components(rows))
    if seed == 1:
        assert jaccard_join.link_documents(none).count() == jaccard_join.keep_one(none).count() == 0


def test_prefixes_share_the_smaller_number():
    """The prefix lemma with a number of matches for each set, and an order by band and frequency."""
    draw = random.Random(9)
    limit = np.uint64(2**63)
    for _ in range(200):
        base = [draw.randrange(2**64) for _ in range(draw.randrange(4, 60))]
        sets = [set(base)] + [{*(t for t in base if draw.random() > 0.1), *(draw.randrange(2**64) for _ in range(draw.randrange(3)))} for _ in range(4)]
        counts = collections.Counter(t for s in sets for t in s)
        chosen = []
        for s in sets:
            shared = np.array(sorted(t for t in s if counts[t] > 1), dtype=np.uint64)
            low = sum(t <= int(limit) for t in s)
            # As the postings do: of the upper band only what a prefix may reach.
            reach = min(len(s), len(s) - int(jaccard_join._least_overlap(len(s), 75, 100)) + 8)
            upper = sorted(t for t in s if t > int(limit))[: max(0, reach - low)]
            shared = np.array([t for t in shared.tolist() if t <= int(limit) or t in upper], dtype=np.uint64)
            chosen.append(jaccard_join.choose_prefix(len(s), low, shared, np.array([counts[int(t)] for t in shared]), 75, 100, 8, draw.choice([0.1, 5.0, 500.0]), limit))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    prefix = lambda c: set(c[1][: c[2]].tolist())
                    assert len(prefix(chosen[a]) & prefix(chosen[b])) >= min(chosen[a][0], chosen[b][0])
                    small, large = (a, b) if len(sets[a]) <= len(sets[b]) else (b, a)
                    assert len(set(chosen[small][1][: chosen[small][3]].tolist()) & prefix(chosen[large])) >= min(chosen[a][0], chosen[b][0])


def test_sketch_bounds_the_difference(spark):
    """Sketches differ in no more bands than the sets in n-grams; sets just below the threshold are told apart."""
    base = prose(11, 300, 100_000)
    rows = [(k, edited(k, base, edits)) for k, edits in enumerate([0, 1, 3, 8, 15, 25, 40] * 4)]
    classes = jaccard_join._identify(spark.createDataFrame(rows, "doc_id long, text string").select("text"), 5, True).withColumn("cls", F.col("one"))
    keys = dict(zip([t for _, t in rows], [r["cls"] for r in jaccard_join._identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("text"), 5, True).withColumn("cls", F.col("one")).collect()], strict=True))
    sketches = {r[0]: r[1:] for r in jaccard_join._sketches(classes, 5).collect()}
    ruled_out = 0
    for (_, a), (_, b) in itertools.combinations(rows, 2):
        one, two = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(sketches[keys[a]], sketches[keys[b]], strict=True))
        assert differ <= len(one ^ two)
        ruled_out += 7 * differ > len(one) + len(two)
        if 100 * len(one & two) >= 75 * len(one | two):
            assert 7 * differ <= len(one) + len(two)
    assert ruled_out > 50


def test_group_just_below_the_threshold(spark):
    """A large group of edited copies that barely do not link: the same components as by brute force, few pairs left to verify."""
    base = prose(77, 100, 100_000)
    rows = [(k, edited(k, base, 4), "a") for k in range(400)]
    got = jaccard_join.link_documents(docs_of(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(brute_components(rows))


def test_keep_one(spark, odd):
    rows, docs = odd
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "9", "None"]
