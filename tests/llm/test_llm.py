"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import ann, chat, decontaminate, packing, pii, quality, queries, secrets, simhash, toxicity, warc
from colloquy.llm.common import running

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, score double, predicted int, y int, fp long, label string, n_chars long"
RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "kamitolu" for b in ("ra", "no", "sti", "ble", "wen", "dor")]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(40)), (5, prose(40)), (6, prose(40)), (None, prose(30, 1)), (None, None),
    (7, prose(30_000, 2)), (8, "x" * 200_000), (9, "Ünïcödé ß 的 \U0001f642 a@b.co +1 (555) 555-1234"), (10, "token = " + "a1" * 12), (11, "1 " * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, 1, 3, "l", 7) for i, t in EDGE], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(1, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def held(out, labels, name):
    rows = out.where("held_out").join(labels.select("doc_id", F.col(name).alias("truth")), "doc_id").collect()
    return sum(r.predicted == r.truth for r in rows) / len(rows), rows


# 1 quality, 10 toxicity


def test_quality_on_held_out_rows(spark):
    out = quality.classify(read(spark, "documents"), read(spark, "labels"))
    assert out.count() == read(spark, "documents").count()
    accuracy, rows = held(out, read(spark, "labels"), "quality")
    assert accuracy > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_statistics_equal_plain_counts():
    odds = lambda k, n: math.log((k + 0.5) / (max(n - k, 0) + 0.5))
    for text in (None, "", "  \n", "one", "a a b\n\nB. 12% é|x\na a b", prose(300, 4) + "!?\n" + prose(20, 5)):
        t = text or ""
        words, lines, raw = t.split(), [x for x in t.split("\n") if x], t.encode()
        share = lambda chars: odds(sum(raw.count(c) for c in chars.encode()), len(raw))
        want = [math.log(1 + len(words)), math.log(1 + (sum(map(len, words)) / len(words) if words else 0)), odds(len(set(words)), len(words))]
        want += [odds(sum(words[i] == words[i + 1] for i in range(len(words) - 1)), max(len(words) - 1, 0)), odds(max([words.count(w) for w in set(words)], default=0), len(words))]
        want += [math.log(1 + max(map(len, words), default=0)), odds(sum(len(w) <= 3 for w in words), len(words)), math.log(1 + len(lines)), odds(len(set(lines)), len(lines)), math.log(1 + (len(t) / len(lines) if lines else 0))]
        want += [share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:'\"()-"), share("!?"), share("#$%&*@^~=+<>[]{}_\\/`"), share("|"), odds(sum(b > 127 for b in raw), len(raw))]
        assert quality.statistics(text) == pytest.approx(want)


def test_discriminant_is_the_textbook_one():
    r = np.random.default_rng(0)
    x = {0: r.normal(0, 1, (400, 3)), 1: r.normal(1, 2, (300, 3))}
    m = quality.discriminant({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()}, 3)
    covs = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    pooled = (400 * covs[0] + 300 * covs[1]) / 700
    logs = []
    for y in (0, 1):
        s = 0.85 * covs[y] + 0.1 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(3)
        z = x[0][:5] - x[y].mean(0)
        logs.append(np.log((len(x[y]) + 1) / 702) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(m.scores(x[0][:5]), 1 / (1 + np.exp(-(logs[1] - logs[0]) / 3)))


def toxic_corpus(spark, n=400):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(["vilefool", "grubbertrash"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_disguises(spark):
    d, lab = toxic_corpus(spark)
    accuracy, _ = held(toxicity.classify(d, lab), lab, "toxic")
    assert accuracy == 1
    model = toxicity.fit(d, lab)
    base = prose(50, 9)
    assert model.score(base) < 0.5 and model.score(None) < 0.5 and model.score("") < 0.5
    for word in ("v1lef0ol", "v i l e f o o l", "viiiilefool", "VILEFOOL!!", "v.i.l.e.f.o.o.l", "grubbertr@sh", "gruubbertrash", "vile​fool"):
        assert model.score(f"{base} {word} {base}") >= 0.5, word
    for word in ("12 34 5", "a b c d e", "3.14", "x@y.com", "| | | |"):
        assert model.score(f"{base} {word} {base}") < 0.5, word
    assert toxicity.reject(d, lab).count() == 266


def test_disguises_in_words_that_seem_plain(spark):
    d, lab = toxic_corpus(spark)
    model = toxicity.fit(d, lab)
    base = prose(50, 9)
    for word in ("vilefооl", "gruррertrаsh vilеfool", "viiiile-fool", "viiiilefool's", "vi-le-fool", "(viilefool)-kara", "vilеfool"):
        assert model.score(f"{base} {word} {base}") >= 0.5, word
    for word in ("kara-no", "li-ble", "tuwen's", "12-34-5", "кора", "5417", "mmmm-oooo", "$$$"):
        assert model.score(f"{base} {word} {base}") < 0.5, word
    signs = toxicity.Model({"^isti$": 5.0, "^isti": 5.0}, model.channel, 0.0)
    assert signs.word("15+1") > 0 and signs.word("1571") > 0 and signs.word("77777") == 0


def test_a_word_anywhere_in_a_long_run_is_found(spark):
    d, lab = toxic_corpus(spark)
    model = toxicity.fit(d, lab)
    other = "karanolitu" * 40
    for at in range(130, 160):
        run = " ".join(other[:at] + "vilefool" + other[: 320 - at])
        assert model.score(run) >= 0.5, at
    assert model.score(" ".join(other)) < 0.5
    assert model.score("vilefooo" + "o" * 50_000 + "l") >= 0.5


def test_trigrams_are_those_of_all_documents(spark):
    d, lab = toxic_corpus(spark)
    more = spark.createDataFrame([(10_000, "quyzzyx " + "a" * 45 + "bcd"), (None, "jfjwq")], "doc_id long, text string")
    model = toxicity.fit(d.unionByName(more), lab, bound=50)
    assert {"quy", "yzz", "zyx", "abc", "cd ", "jfj"} <= set(model.channel.trigrams)


def test_trigrams_equal_plain_counts():
    texts = ["", "a", "Ab cD.e", "ﬁne soft\u00adware x1y2z", "é的b  的" + "\U00010400k", prose(200, 8), "12 34"]
    want = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", toxicity.unicodedata.normalize("NFKC", t).lower().replace("\u00ad", "")):
            p = f"  {w} "
            for i in range(len(p) - 2):
                want[p[i : i + 3]] = want.get(p[i : i + 3], 0) + 1
    assert toxicity.trigrams(texts) == want
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 600)))
    assert toxicity.trigrams([many])[many[5:8]] == 1


def test_decoder_finds_the_best_of_all_readings():
    """Against every path of small lattices: each sign read as itself or what it stands for, or, in a run, left out."""
    from itertools import product

    r = random.Random(2)
    counts = {"".join(x): r.randint(1, 50) for x in product(" aeilst", repeat=3) if r.random() < 0.5}
    channel = toxicity._channel(counts)
    for _ in range(150):
        seen = "".join(r.choice("aeilst1543@") for _ in range(r.randint(1, 5)))
        best = -1e9
        ways = [[(c, 0.0), *((x, toxicity.CHANNEL) for x in toxicity.LEET.get(c, ""))] + ([("", toxicity.SKIP)] if i and c == seen[i - 1] else []) for i, c in enumerate(seen)]
        values = {}
        for path in product(*ways):
            text = "".join(x for x, _ in path)
            padded = "  " + text + " "
            value = sum(channel.step(padded[i : i + 2], padded[i + 2]) for i in range(len(padded) - 2)) - sum(cost for _, cost in path)
            values[text] = max(value, values.get(text, -1e9))
            best = max(best, value)
        assert values[channel.decode(seen)] == pytest.approx(best, abs=1e-9), seen


def test_score_is_the_logistic_of_what_a_text_holds(spark):
    d, lab = toxic_corpus(spark)
    model = toxicity.fit(d, lab)
    for text in ("", None, prose(40, 1), f"{prose(30, 2)} vilefool {prose(5, 3)}", f"{prose(30, 2)} grubbertr@sh vilefool. vilefool"):
        held = {x for w in (text or "").replace("@", "a").replace(".", "").split() for x in toxicity.features(w)} & set(model.weights)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-model.prior - sum(model.weights[x] for x in held))), rel=1e-9)


def test_regression_is_at_its_optimum(spark):
    """The penalised likelihood's slope is near zero, so the weights are those that a plain solver would find."""
    d, lab = toxic_corpus(spark)
    model = toxicity.fit(d, lab)
    sample = {r.doc_id: r.toxic for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    slope, bias = dict.fromkeys(model.weights, 0.0), 0.0
    for r in d.collect():
        if r.doc_id in sample:
            off = model.score(r.text) - sample[r.doc_id]
            bias += off
            for x in model.found(r.text):
                slope[x] += off
    rest = [s + toxicity.PENALTY * model.weights[x] for x, s in slope.items()]
    assert max(map(abs, rest)) < 1.5 and abs(bias) < 1.5


def test_classifiers_meet_any_table(spark, docs, labels):
    for m in (quality, toxicity):
        rows = m.classify(docs, labels).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out is False for r in rows if r.doc_id is None)
        assert m.classify(docs.limit(0), labels).count() == 0
        assert {r.predicted for r in m.classify(docs, labels.limit(0)).collect()} <= {0, 1}
    assert toxicity.reject(docs, labels).columns == docs.columns


# 2 decontamination


def edits(a, b):
    """The least distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [(i, prose(r.randint(4, 14), 100 + i)) for i in range(12)] + [(90, None), (91, "  "), (92, "ra")]
    rows = []
    for i in range(60):
        text = prose(r.randint(5, 25), 500 + i)
        if i % 2:
            item = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, len(item) // 7)):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice([[], [r.choice("xyz")], [item[k], r.choice("xyz")]])
            text = text[: r.randrange(len(text))] + "".join(item).upper() + "\n " + text
        rows.append((i, text))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        for k, s in items:
            s = decontaminate.normal(s)
            if s and (e := edits(s, decontaminate.normal(t))) <= int(len(s) * 0.1):
                want[i, k] = e
    assert got == want


def test_decontamination_meets_any_table(spark, docs):
    bench = spark.createDataFrame([(1, prose(40)), (1, prose(40)), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.matches(docs, bench).collect()) == [5, 5, 6]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGE) - 3


# 3 neighbours


def test_neighbours_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), shard=200).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = sorted(v)
    m = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    found = 0
    for q, ranks in got.items():
        s = m @ (v[q] / np.linalg.norm(v[q]))
        best = [i for _, i in sorted((-x, i) for x, i in zip(s, ids, strict=True) if i != q)][:5]
        found += len({i for i, _ in ranks.values()} & set(best))
        assert sorted(ranks) == [1, 2, 3, 4, 5] and q not in [i for i, _ in ranks.values()]
        assert all(abs(x - s[ids.index(i)]) < 1e-9 for i, x in ranks.values())
    assert len(got) == 50 and found / 250 >= 0.9


def test_neighbours_over_many_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), shard=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q, near in got.items():
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -2
        found += len(near & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert len(rows) >= 8 * 200 and found / (5 * len(got)) >= 0.9


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 1e200]), (2, [1e-200, 1e-200]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, query_id int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, df).collect()}
    assert [got[0, i][0] for i in (1, 2, 3)] == [1, 2, 3]
    assert got[0, 1][1] == pytest.approx(2 / math.sqrt(5)) and got[3, 1][1] == pytest.approx(math.sqrt(0.5))


def test_beams_hold_no_point_twice():
    r = np.random.default_rng(3)
    for n in (20, 60, 300):
        x = ann.unit(r.normal(size=(n, 8)))
        graph, start = ann.build(x)
        ids, _ = ann.beam_search(x, graph, start, ann.unit(x[-1:] + 0.1 * r.normal(size=(40, 8))), ann.SEARCH_BEAM)
        assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in ids)


def test_neighbours_of_the_last_point_are_distinct(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df, shard=20).collect()
    assert len({(x.query_id, x.vec_id) for x in rows}) == len(rows) == 300


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(150)], "vec_id long, embedding array<double>")
    asked = df.unionByName(spark.createDataFrame([(999, [1.0, 2.0])], df.schema))  # no vector has this length
    one = sorted(map(tuple, ann.nearest(df, asked, shard=40).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, ann.nearest(df, asked, shard=40).collect())) == one
    assert len(one) == 150 * 5 and 999 not in {x[0] for x in one}


def test_neighbours_meet_any_table(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0]), (53, [float("nan"), 1.0]), (54, [None, 1.0]), (55, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, e, 1.0) for i, e in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 10, 50, 51, 60)")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 10: [0, 1, 2, 3, 4], 50: [0, 1, 2, 3, 4]}
    assert ann.nearest(df.limit(0), df).count() == 0


# 4 chat


def test_longest_common_prefix(spark):
    t = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(1, t, [*t[:3], ("assistant", "e")]), (2, t, t), (3, t, None), (4, [], []), (5, t, [("user", "z")]), (6, t[:2], t), (7, [None, (None, None)], [(None, "<|x|>")])]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, n int, prompt string"
    out = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame([(*r, 1, "p") for r in rows], schema)).collect()}
    say = lambda role, x: f"<|{role}|>\n{x}\n<|end|>\n"
    assert (out[1].prompt_turns, out[1].prompt) == (3, "".join(say(*x) for x in t[:3]))
    assert (out[1].chosen, out[1].rejected) == (say("assistant", "d"), say("assistant", "e"))
    a, b = map(int, out[1].chosen_mask.split(":"))
    assert out[1].chosen[a:b] == "d\n<|end|>\n"
    assert (out[2].prompt_turns, out[2].chosen, out[2].rejected) == (4, "", "")
    assert (out[3].prompt, out[3].rejected, out[3].chosen_mask.count(":")) == ("", "", 2)
    assert (out[4].prompt, out[4].chosen) == ("", "")
    assert out[5].prompt_turns == 0 and out[6].chosen == "" and out[6].rejected == say("user", "c") + say("assistant", "d")
    assert out[7].rejected == "<|unknown|>\n< |x|>\n<|end|>\n"
    for r in out.values():
        for span in filter(None, r.chosen_mask.split(",")):
            a, b = map(int, span.split(":"))
            assert r.chosen[a:b].endswith("\n<|end|>\n")


def test_conversations_of_any_shape(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, None, None, None), (3, 1, "assistant", "a")]
    c = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    out = {r.pair_id: r for r in chat.preference_pairs(chat.self_pairs(c)).collect()}
    say = lambda role, x: f"<|{role}|>\n{x}\n<|end|>\n"
    assert set(out) == {1, 2, 3}
    assert (out[1].prompt, out[1].chosen, out[1].rejected) == (say("user", "q"), say("assistant", ""), say("assistant", "q"))
    assert (out[2].prompt, out[2].chosen, out[2].rejected) == (say("user", "only"), "", "")
    assert (out[3].prompt, out[3].chosen, out[3].rejected) == (say("unknown", ""), say("assistant", "a"), say("assistant", ""))
    assert chat.preference_pairs(chat.self_pairs(c.limit(0))).count() == 0


def test_long_conversations_and_roles_like_markers(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "w" * 50 + str(i)) for i in range(3001)] + [(2, 0, "<|x|>\ny", "t"), (2, 1, "assistant", "a")]
    c = spark.createDataFrame([(*t, 1, "p") for t in turns], "conv_id long, turn long, role string, text string, pair_id int, rejected string")
    out = {r.pair_id: r for r in chat.preference_pairs(chat.self_pairs(c)).collect()}
    assert out[1].prompt_turns == 2999 and out[1].prompt.count("<|end|>") == 2999
    assert out[1].chosen == "<|assistant|>\n" + "w" * 50 + "2999\n<|end|>\n" and out[1].rejected == "<|assistant|>\n" + "w" * 50 + "1\n<|end|>\n"
    assert out[2].prompt == "<|< |x| > y|>\nt\n<|end|>\n"


# 5 secrets


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_brute_force(spark, docs):
    r = random.Random(8)
    bits = ["token: ", "PassWord=", "api_key = '", "secret", ": ", "ſecret=abcdefg", "AKIA", "ABCD1234EFGH5678IJKL", "deadbeef" * 4, "token: token: abcdefg ", "é", "\U0001f642", " ", "\n", "abc", "x" * 5, "0123456789abcdef01234567", "="]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(300)] + [(1000, " ".join("token=abcdef%d" % i for i in range(3000)))]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    for x in out.collect():
        assert x.base_spans == base_secrets(texts[x.doc_id])
        assert set(filter(None, x.base_spans.split(","))) <= set(x.spans.split(","))
    assert secrets.scan(docs).count() == len(EDGE) and secrets.scan(docs.limit(0)).count() == 0
    empty = [x for x in secrets.scan(docs).collect() if x.doc_id in (1, 2, 3)]
    assert all((x.n_assign, x.n_hex, x.spans) == (0, 0, "") for x in empty)


def test_randomness_battery(spark):
    r = random.Random(2)
    alphabet = secrets.ENCODINGS[-1][2]
    rows = [(i, "key " + "".join(r.choice(alphabet[:62]) for _ in range(40)) + " end") for i in range(200)]
    rows += [(1000 + i, "path some/long/path/with/words/and/number/" + str(i % 10) + "/again/and/again/some/more") for i in range(200)]
    out = {x.doc_id: x.n_random for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i] for i in range(200)) >= 180
    assert sum(out[1000 + i] for i in range(200)) <= 10


def test_thresholds_equal_the_plain_rule(spark):
    """Benjamini and Hochberg's rule within each class of lengths, on p-values rounded down to steps as stated."""
    r = random.Random(9)
    rows = [(0, n, 10 ** -(r.random() ** 3 * 8)) for n in (r.randint(20, 120) for _ in range(500))]
    spans = spark.createDataFrame([([x],) for x in rows], "candidates array<struct<start:bigint,end:bigint,p:double>>")
    want = {}
    for size in {int(math.log2(n)) for _, n, _ in rows}:
        steps = sorted((math.floor(-math.log10(p) * secrets.STEPS) for _, n, p in rows if int(math.log2(n)) == size), reverse=True)
        passed = [s for s in steps if 10 ** (-s / secrets.STEPS) <= secrets.RATE * sum(x >= s for x in steps) / len(steps)]
        if passed:
            want[size] = min(passed)
    assert secrets.thresholds(spans) == want and want


def test_what_a_candidate_needs_is_a_parameter(spark):
    r = random.Random(3)
    d = spark.createDataFrame([(1, "key " + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(60)))], "doc_id long, text string")
    assert secrets.scan(d).first().n_random == 0 and secrets.scan(d, needs=()).first().n_random == 1


def test_p_values_follow_their_tests(spark):
    r = random.Random(1)
    s = "".join(r.choice("0123456789abcdef") for _ in range(64))
    v = ["0123456789abcdef".index(c) + 1 for c in s]
    n, k = 64, 16
    upper = lambda z: 1 / (1 + math.exp(1.5976 * max(-12, min(12, z)) + 0.070565992 * max(-12, min(12, z)) ** 3))
    chi = k / n * sum(v.count(j) ** 2 for j in range(1, 17)) - n
    p1 = upper(((chi / 15) ** (1 / 3) - (1 - 2 / 135)) / math.sqrt(2 / 135))
    up = [x * 2 > k for x in v]
    n1 = sum(up)
    both = 2 * n1 * (n - n1)
    runs = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    p2 = 2 * upper(abs(runs - both / n - 1) / math.sqrt(both * (both - n) / (n * n * (n - 1))))
    m = sum(v) / n
    rho = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / sum((a - m) ** 2 for a in v)
    p3 = 2 * upper(abs(rho + 1 / n) * math.sqrt(n))
    x = -(math.log(p1) + math.log(p2) + math.log(p3))
    spans = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(64).cast("long").alias("end"), F.lit(s).alias("value")))
    got = spark.range(1).select(secrets.tested(spans).alias("t")).first().t[0].p
    assert got == pytest.approx(math.exp(-x) * (1 + x + x * x / 2), rel=1e-6)


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        xs = list(range(n))
        got = spark.createDataFrame([(xs,)], "a array<bigint>").select(running(F.col("a")).alias("r")).first().r
        assert got == [sum(xs[:i]) for i in range(n)]


def test_spans_apart_from_many_others(spark):
    r = np.random.default_rng(8)

    def spans(n):
        cuts = np.sort(r.choice(400, 2 * n, replace=False)).tolist()
        return list(zip(cuts[::2], cuts[1::2], strict=True))

    rows = [(i, spans(int(r.integers(0, 40))), spans(int(r.integers(0, 40)))) for i in range(200)]
    span = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame(rows, f"i long, a {span}, b {span}")
    got = {x.i: [tuple(s) for s in x.c] for x in df.select("i", secrets._apart(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {i: [s for s in a if not any(o[0] < s[1] and s[0] < o[1] for o in b)] for i, a, b in rows}
    assert any(got.values())


# 6 packing


def check_packing(rows, ids_of):
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids_of[i][at : at + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids_of[i]))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[i])
    return padding, seqs


def test_packing_holds_each_id_once(spark):
    d = read(spark, "documents")
    t = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in d.collect()}
    padding, _ = check_packing(packing.pack(d, WORD_BPE, with_ids=False).collect(), ids)
    assert padding == 0
    rows = packing.pack(d, WORD_BPE).collect()
    assert all(r.input_ids == ids[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_packing_puts_like_documents_together():
    r = np.random.default_rng(0)
    docs = [np.concatenate((r.integers(0, 40, 200), 1000 * (i % 5 + 1) + r.integers(0, 30, 200))) for i in range(100)]
    same = total = 0
    for row in packing.pack_shard(docs, 2048):
        kinds = [d % 5 for d, _, _ in row]
        same += sum(a == b for a, b in zip(kinds, kinds[1:], strict=False))
        total += len(kinds) - 1
    assert same / total > 0.8


def test_packing_draws_all_that_share_a_term():
    r = np.random.default_rng(1)
    docs = [100 * (i % 3 + 1) + r.integers(0, 30, 20) for i in range(300)]
    assert [d % 3 for d, _, _ in next(packing.pack_shard(docs, 2000))] == [0] * 100
    heavy = np.repeat(np.arange(12), 2)
    docs = [np.append(heavy, 12), *(np.arange(100 * i, 100 * i + 25) for i in range(1, 20)), heavy, np.append(np.arange(5000, 5024), 12)]
    assert [d for d, _, _ in next(packing.pack_shard(docs, 70))] == [0, 20, 21]


def test_packing_meets_any_table(spark, docs):
    distinct = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    t = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in distinct.collect()}
    check_packing(packing.pack(distinct, WORD_BPE, with_ids=False).collect(), ids)
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0
    assert packing.pack(docs, WORD_BPE).agg(F.count_distinct("sequence_id")).first()[0] > 0


def test_neighbours_are_ranked_by_the_textbook_formula():
    r = np.random.default_rng(7)
    docs = [np.concatenate((r.integers(0, 12, r.integers(1, 30)), 100 + r.integers(0, 900, r.integers(1, 40)))) for _ in range(80)]
    index, n, mean = packing.Index(docs), 80, sum(map(len, docs)) / 80
    df = {t: sum(t in d for d in docs) for t in {int(t) for d in docs for t in d}}
    used = np.zeros(n, bool)
    used[[3, 8]] = True
    assert (index.dense >= 0).any() and (index.dense < 0).any()
    for seed in range(0, 80, 9):
        want = {}
        for i, d in enumerate(docs):
            shared = {int(t) for t in docs[seed]} & {int(t) for t in d}
            tf = {t: int((d == t).sum()) for t in shared}
            k = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
            value = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + k) for t in shared if df[t] > 1)
            if value and not used[i]:
                want[i] = value
        got = index.neighbours(seed, used).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_encoder_equals_the_tokenizer_on_any_character():
    e = packing.encoder(WORD_BPE)
    assert e.by_word
    chars = [chr(c) for c in (*range(0x3000), *range(0xFB00, 0xFFFF), 0x10400, 0x1E900, 0x1F642)]
    texts = [f"alpha{c}beta Gam{c} {c}{c}don't{c}. {c}, x{c}{c}y" for c in chars]
    r = random.Random(12)
    texts += ["".join(r.choice(["a", "B", " ", ".", "'s", "1", "\x1c", "\x1f", "\x85", "\u200b", "é", "e\u0301", "İ", "ς", "Σ", "的"]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["don't stop.", "a,b;; c!!", "İstanbul ΣΑΣ ß.", "x́y é", "<|endoftext|> a", "ª. º, é! 1. 2.", "tab\tnew\nline\x0bv\x85n m", "ſ K", ""])
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(WORD_BPE)
    assert e.encode([text, "a b", text])[2].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# 7 personal data


def test_pii_spans_apart_equal_the_plain_comparison():
    r = random.Random(3)
    spans = lambda n: [(a, a + r.randint(1, 30), "email") for a in (r.randint(0, 300) for _ in range(n))]
    for _ in range(300):
        some, others = spans(r.randint(0, 12)), spans(r.randint(0, 12))
        assert pii.apart(some, others) == [s for s in some if not any(s[0] < b[1] and b[0] < s[1] for b in others)]


def test_pii_time_is_linear_in_spans():
    field = pii.train(rounds=10)

    def seconds(n):
        text = "\n".join(f"ann{i}@mail.example.org +1 (555) {i % 1000:03}-12{i % 100:02}" for i in range(n))
        began = time.process_time()
        (base, _), = pii.find(field, [text])
        assert len(base) == 2 * n
        return time.process_time() - began

    seconds(1000)
    assert seconds(32_000) < 16 * seconds(4_000)


def base_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text if "@" in text else "")]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_exact_patterns_equal_plain_ones():
    r = random.Random(6)
    bits = ["a", "b.c", "@", "@@", "x@y.z", ".", "..", "1.2.3.4", "255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-1234", "+", "+44", " ", "-", "é", "的", "\n", "0", "00012", "5" * 20, "a@b", "a@b.c@d.e", "%"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == base_pii(text), text


def test_field_accuracy_and_added_spans():
    field = pii.train()
    right = total = 0
    for words, truth in pii.training_table(300, 99):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        codes = pii.codes_of(raw, *pii.words_of(raw))
        got = [pii.LABELS[k] for k in field.decode(codes, np.zeros(len(codes), int))]
        right += sum(a == b for a, b in zip(got, truth, strict=True))
        total += len(truth)
    assert right / total > 0.98
    text = "Wörte hier (555) 555-1234 und +1 (578) 555-6437 4918187128635271 ende"
    (base, spans), = pii.find(field, [text])
    found = {text[a:b]: k for a, b, k in spans}
    assert not base and found["4918187128635271"] == "card" and "phone" in found.values()
    assert "555" not in pii.masked(text, spans)
    clean = prose(200, 3)
    assert list(pii.find(field, [clean, ""])) == [([], []), ([], [])]


def test_shapes_of_long_words_and_places_of_many_spans():
    long = b"1" * 300 + b"a" * 2000 + b"." * 700
    raw = np.frombuffer(long + b" " + b"1" * 20 + b"a.....", np.uint8)
    a, b = pii.codes_of(raw, *pii.words_of(raw)).tolist()
    assert a == b
    field = pii.train()
    text = "é " + " wörd ".join(f"(555) 555-{1000 + i}" for i in range(400)) + "\n" + "x" * 500
    (_, spans), = pii.find(field, [text])
    assert len(spans) >= 390 and all(re.fullmatch(r"\(?555\) 555-\d{4}", text[a:b]) for a, b, _ in spans)


def test_viterbi_is_the_best_path():
    field = pii.train(rounds=15)
    r = random.Random(1)
    words = ["+1", "(555)", "555-1234", "4111", "1111", "the", "a@b.co", "1.2.3.4", "x"]
    from itertools import product

    for _ in range(20):
        line = [r.choice(words) for _ in range(r.randint(1, 4))]
        raw = np.frombuffer(" ".join(line).encode(), np.uint8)
        codes = pii.codes_of(raw, *pii.words_of(raw))
        at = np.zeros(len(codes), int)
        e = field.emissions(codes, at)
        value = lambda p, e=e: sum(e[i, y] for i, y in enumerate(p)) + pii.Field._first()[p[0]] + sum(field.steps[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(value(p) for p in product(range(len(pii.LABELS)), repeat=len(line)))
        assert value(tuple(field.decode(codes, at))) == pytest.approx(best, abs=1e-3)


def test_personal_data_meets_any_table(spark, docs):
    field = pii.train(rounds=20)
    rows = pii.scan(docs, field).collect()
    assert len(rows) == len(EDGE)
    texts = dict(EDGE)
    for r in rows:
        if r.doc_id is not None:
            assert r.base_spans == pii.spell(base_pii(texts[r.doc_id] or ""))
    out = pii.redact(docs, field)
    assert out.columns == docs.columns and out.where("text is null").count() == 2
    assert "a@b.co" not in out.where("doc_id = 9").first().text
    assert pii.scan(docs.limit(0), field).count() == 0


# 8 near duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components_of(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components_equal_brute_force(spark):
    d = read(spark, "documents")
    rows = {r.doc_id: r.text for r in d.collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    want = components_of(fps, 3)
    got = queries.op8_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in rows}


@pytest.mark.parametrize("radius,part,same", [(3, 2000, 1), (3, 7, 1), (1, 5, 1), (3, 2000, 2), (3, 7, 3), (1, 5, 2), (0, 5, 1)])
def test_links_lose_nothing_in_dense_groups(spark, radius, part, same):
    r = random.Random(radius)
    seeds = [r.getrandbits(64) for _ in range(6)]
    xs = sorted({s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) for s in seeds for _ in range(40)})
    signed = [x - (1 << 64) if x >> 63 else x for x in xs]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(simhash.keyed(df, radius, same), radius, part)
    top = {x.node: x.root for x in simhash.roots(edges).collect()}
    want = components_of(dict(zip(signed, xs, strict=True)), radius)
    groups = lambda m: sorted(sorted(i for i in signed if m.get(i, i) == k) for k in {m.get(i, i) for i in signed})
    assert groups(top) == groups(want)


def test_keys_thin_out_as_fingerprints_grow():
    assert [simhash.blocks_of_key(n, 3) for n in (10, 10**8, 10**9, 10**12, 10**15)] == [1, 1, 2, 3, 3]


def test_bk_tree_finds_all_within():
    r = random.Random(1)
    xs = {r.getrandbits(24) for _ in range(400)}
    tree = simhash.BKTree()
    for x in xs:
        tree.add(x)
    for q in list(xs)[:20]:
        assert {y for y, _ in tree.within(q, 4)} == {y for y in xs if (y ^ q).bit_count() <= 4}


def test_near_copies_go_and_others_stay(spark, docs):
    base = [prose(150, 50 + i).split() for i in range(30)]
    rows, n = [], 0
    for i, words in enumerate(base):
        for k in range(4):
            w = list(words)
            for _ in range(k):
                w[RNG.randrange(150)] = "changed"
            rows.append((n, " ".join(w)))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    kept = sorted(r.doc_id for r in simhash.keep_one(d).collect())
    assert set(range(0, 120, 4)) <= set(kept) and len(kept) <= 33
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.where("doc_id is not null").collect())
    assert ids == [1, 4, 5, 7, 8, 9, 10, 11] and out.where("doc_id is null").count() == 2
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (None, "a b", "x"), (None, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, copy string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.copy) for r in kept) == [(0, "a b", "x"), (0, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (3, "", "x")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def alike(texts):
    """The least id that links of texts with a similarity of 0.8 or more reach, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if top[a] != top[b] and (5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((top[a], top[b]))
                top = {i: low if x == high else x for i, x in top.items()}
    return top


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("common", [2000, 3])
def test_near_copies_are_all_texts_of_a_similarity_and_no_others(spark, common):
    r = random.Random(11)
    line, texts = prose(30, 900), []
    for i in range(60):
        words = prose(r.choice([6, 40, 150, 400]), 1000 + i).split()
        texts.append(" ".join(words) + (f" {line}" if i % 2 else ""))
        for _ in range(3):  # changes in one place: similarities from 0.5 to 1
            at, n = r.randrange(len(words)), r.randint(0, max(1, len(words) // 4))
            texts.append(" ".join(words[:at] + [f"other{r.random()}" for _ in words[at : at + n]] + words[at + n :]) + (f" {line}" if i % 2 else ""))
    top = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a, texts[j]) >= 0.8 and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.copy: x.kept for x in simhash.near_copies(d, common=common).collect()}
    assert got == {i: x for i, x in enumerate(top) if i != x} and 20 < len(got) < 150


def test_parts_of_a_group_of_candidates_are_compared_with_each_other(spark):
    sets = [(i, np.sort(np.arange(100) + i * 5).astype("<u8").tobytes()) for i in range(40)]
    rows = spark.createDataFrame(sets, "node long, own binary")
    edges = simhash._alike(rows, rows.select("node", F.lit(0).cast("long").alias("root")), part=7)
    assert {x.root for x in simhash.roots(edges).collect()} == {0} and {abs(x.a - x.b) for x in edges.collect()} <= {1, 2}


def test_fingerprints_meet_any_table(spark, docs):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(EDGE)
    same = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert same[1] == same[2] == same[3] == 1 and same[6] == 5
    assert all(r.fp == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert simhash.components(docs.limit(0)).count() == 0


# 9 archives


def test_archives_round_trip(spark):
    big = prose(20_000, 7) + "é的\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", big)]
    p = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(2)
    got = warc.round_trip(p).collect()
    assert len(got) == len(rows)
    for r in got:
        html = dict((i, h) for i, _, h in rows)[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None), (None, "response", None)}
    assert warc.round_trip(p.limit(0)).count() == 0


def test_framing():
    for n in (0, 1, 8192, 8193, 50_000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.dechunked(warc.chunked(data)) == data
    for bad in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_broken_segments_are_told(spark):
    parts = list(warc.records(1, "u", "y" * 100_000, None, "0-0"))
    assert len(parts) == 4
    fields = [next(iter(warc.parse([p + b"\r\n\r\n"])))[0] for p in parts]
    assert [f["warc-type"] for f in fields] == ["response", *["continuation"] * 3] and "warc-segment-total-length" in fields[-1]
    import gzip
    import os
    import tempfile

    for keep, error in (((0, 1, 2, 3), None), ((0, 2, 3), "missing segment"), ((0, 1, 2), None)):
        where = tempfile.mkdtemp()
        with gzip.open(os.path.join(where, "a.gz"), "wb") as f:
            f.write(b"".join(parts[i] + b"\r\n\r\n" for i in reversed(keep)))
        got = warc.read(spark, f"file://{where}").collect()
        assert len(got) == 1
        if len(keep) == 4:
            assert got[0].error is None and got[0].payload_bytes == 100_000
        else:
            assert got[0].error


def test_archives_of_other_writers(spark, tmp_path):
    import base64
    import gzip

    def record(kind, body, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{zlib.crc32(body)}>", "Content-Length": len(body)} | {k.replace("_", "-"): v for k, v in more.items()}
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + body + b"\r\n\r\n"

    page = lambda i: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"page %d" % i
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"page 1").digest()).decode()
    parts = [record("warcinfo", b"software: x"), record("response", page(1), X_Page_Id=1, WARC_Payload_Digest=digest), record("response", page(2), X_Page_Id=2), record("resource", b"bare", X_Page_Id=3)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "junk.warc").write_bytes(parts[1] + b"nothing here" + b"\r\n\r\n" + parts[2])
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(parts[1]) + gzip.compress(parts[2])[:-20])
    got = {}
    for r in warc.read(spark, f"file://{tmp_path}").collect():
        got[r.page_id, r.payload_bytes, r.error] = got.get((r.page_id, r.payload_bytes, r.error), 0) + 1
    assert got[1, 6, None] == 4 and got[2, 6, None] >= 3 and got[3, 4, None] == 2
    errors = sorted(e for _, _, e in got if e)
    assert len(errors) >= 2 and any("are no record" in e for e in errors) and any("gzip" in e for e in errors)
    many = b"".join(gzip.compress(record("response", page(i), X_Page_Id=i)) for i in range(2000))
    assert sum(1 for f, _ in warc.parse(warc.members(many)) if f) == 2000


# pipeline


def test_pipeline_equals_its_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = read(spark, "documents")
    model = toxicity.fit(d, read(spark, "labels"))
    rows = {r.doc_id: r.text for r in d.collect()}
    rows = {i: t for i, t in rows.items() if model.score(t) < 0.5}
    tops = alike(rows)
    items = [decontaminate.normal(r.text) for r in read(spark, "benchmark").collect()]
    kept = {i: t for i, t in rows.items() if tops[i] == i and not any(s in decontaminate.normal(t) for s in items)}
    t = Tokenizer.from_file(WORD_BPE)
    field = pii.train()
    ids = {i: [*t.encode(pii.masked(x, next(iter(pii.find(field, [x])))[1]), add_special_tokens=False).ids, 1] for i, x in kept.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(ids)
    check_packing(got, ids)
