import json
import random
import re

import numpy as np
import pytest

from gridsmith.llm import leakage, prose, reading, tokenize

TEXTS = [
    "", None, "hello world", "it's I'LL we've   two  spaces \n\n\n x", "<|endoftext|>", "日本語 ½ ² Ⅳ naïve 🛰️\u200d", "a" * 3000, "=" * 777 + "b", " " * 50, "\t\tif x:\r\n  y", "x\u00a0y\u2028z",
    "\x1c\x1d!", "hyperheteroscedasticity " * 20, "don't 'tis 's", "0123456789" * 30, "ﬁ İıſß 𝒳𝒴",
]


def test_tokens_match_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("ab'st 19.\n\té界 ") for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenize.encode(df).collect()}
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
    assert tokenize.encode(df.limit(0)).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_BYTES", 500)
    e = tokenize.Encoder(tokenize.DEFAULT_VOCABULARY)
    one = e.encode(["a b c d e f g", "a b"])[0].tolist()
    e.encode(["h i j k l m"])
    assert e.encode(["a b c d e f g", "a b"])[0].tolist() == one and e.size < 2000


def test_long_words():
    """Words of any length by the one query: random letters, runs, periods, digits, other alphabets."""
    tokenizers = pytest.importorskip("tokenizers")
    t, rnd = tokenizers.Tokenizer.from_file(tokenize.DEFAULT_VOCABULARY), random.Random(9)
    e = tokenize.Encoder(tokenize.DEFAULT_VOCABULARY)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    words = [pick("abcdefghijklmnopqrstuvwxyz", n) for n in (63, 64, 65, 200, 3000, 40_000)] + [pick(a, 2500) for a in ("ab", "aab", "=-", "=", "0123456789", "éè", "界面", "eIt")]
    words += [c * n for c in ("=", "a", "é", "7", "ab", "aab") for n in (31, 64, 129, 1000, 5001)]
    got = e.merge(words)
    assert [x.tolist() for x in got] == [x.ids for x in t.encode_batch(words, add_special_tokens=False)]


WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je") for b in ("ran", "lem", "tis", "kor", "pun", "vax")]


def brute(item: list[str], doc: list[str]) -> bool:
    """Edit distance of every span of 30 words or more with free ends in the document, one edit in ten allowed."""
    for i in range(len(item) - 29):
        p = item[i:]
        row = list(range(len(p) + 1))
        if any(row[n] <= n // 10 for n in range(30, len(p) + 1)):
            return True
        for x in doc:
            new = [0]
            for k in range(1, len(p) + 1):
                new.append(min(row[k - 1] + (p[k - 1] != x), row[k] + 1, new[k - 1] + 1))
            row = new
            if any(row[n] <= n // 10 for n in range(30, len(p) + 1)):
                return True
    return False


def edited(words, n, rnd):
    w = list(words)
    for _ in range(n):
        k = rnd.randrange(len(w))
        how = rnd.randrange(3)
        if how == 0:
            w[k] = "changed"
        elif how == 1:
            del w[k]
        else:
            w.insert(k, "added")
    return w


def test_leaks_against_brute_force(spark):
    rnd = random.Random(5)
    items = [[rnd.choice(WORDS) for _ in range(rnd.choice([20, 30, 45, 70]))] for _ in range(12)]
    docs = []
    for n in range(150):
        it = rnd.choice(items)
        a = rnd.randrange(max(1, len(it) - 29))
        part = it[a : a + rnd.choice([25, 29, 30, 31, 40, 45, 52, 66])]
        pad = lambda: [rnd.choice(WORDS) for _ in range(rnd.randrange(15))]
        docs.append(pad() + edited(part, rnd.choice([0, 1, 2, 3, 4, 4, 5, 6, 7]), rnd) + pad())
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] + [(900, None), (901, ""), (902, "x " * 50000)], "doc_id long, text string")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, item_text string")
    got = {(r[0], r[1]) for r in leakage.leaked(d, t).collect()}
    want = {(i, k) for i, w in enumerate(docs) for k, it in enumerate(items) if brute(it, w)}
    assert got == want and len(want) > 30
    assert leakage.leaked(d, t.limit(0)).count() == 0
    assert leakage.clean(d, t).count() == d.count() - len({i for i, _ in want})


def test_longer_leaks_with_one_edit_in_ten(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    hit = lambda n, at: " ".join("changed" if k in at else x for k, x in enumerate(w[:n]))
    more = {11: "one", 17: "two", 23: "three", 29: "four"}
    docs = {
        1: hit(40, (10, 16, 22, 29)), 2: hit(45, (15, 18, 22, 29)), 3: hit(50, (20, 22, 24, 26, 29)), 4: hit(40, (10, 16, 20, 22, 29)), 5: hit(39, (10, 16, 22, 28)),
        6: " ".join(x for k, x in enumerate(w[:40]) if k not in more), 7: " ".join(f"{more.get(k, '')} {x}" for k, x in enumerate(w[:40])),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(w))], "item_id long, item_text string")
    assert sorted(r["doc_id"] for r in leakage.leaked(d, t).collect()) == [1, 2, 3, 6, 7]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 250)
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    t = spark.createDataFrame([(k, " ".join(w[k * 35 : k * 35 + 35])) for k in range(5)], "item_id long, item_text string")
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert len(list(leakage._blocks(t, "item_id", "item_text"))) == 5
    got = leakage.leaked(d, t)
    assert sorted(r["item_id"] for r in got.collect()) == [0, 1, 2, 3, 4] and got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_passages_are_cut(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    disguised = "// " + "\n// ".join(" ".join(w[k : k + 9]) for k in range(0, 45, 9)).replace("wab", "w\u200bab").replace("wbc", "<b>wb</b>c").replace(" wad", "&nbsp;wad")
    docs = {1: "before it " + " ".join(w[:40]) + " after it", 2: "kept as it is, " * 20, 3: "Head.\n" + disguised + "\nint x = 3;", 4: None, 5: " ".join(w) + " tail", 6: "a " + " ".join("zz" if k % 11 == 5 else x for k, x in enumerate(w[:44])) + " b " + " ".join(w[50:85])}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(w))], "item_id long, item_text string")
    got = {r["doc_id"]: (r["text"], r["n_cut"]) for r in leakage.redacted(d, t).collect()}
    assert got[2] == (docs[2], 0) and got[4] == (None, 0)
    assert got[1][0].split() == ["before", "it", "after", "it"] and got[3][0].split() == ["Head.", "//", "int", "x", "=", "3;"] and got[5][0].split() == ["tail"]
    # Passages of one item at most ten words apart are one.
    assert got[6][0].split()[0] == "a" and set(got[6][0].split()) <= {"a", "b", "zz", *w[:6]} and got[6][1] == 1
    assert leakage.leaked(leakage.redacted(d, t), t).count() == 0


def test_disguises():
    want = "the old king sees a small red house".split()
    forms = [
        "THE old, king; sees a small -- red house!", "// the old king\n// sees a small\n// red house", '"the old king " +\n   "sees a small red house"', "the old\\nking sees\\ta small red\\u0020house",
        "the <b>old</b> ki<i>ng</i> sees<br/>a **small** _red_ `house`", "the o\u200bld ki\u00adng sees a small\u2060 red house", "the old&nbsp;king sees a small red house", "the old king sees a small red hou-\n# se", "the\\u200bold ki\\u00adng sees a small red house".replace("the\\u200bold", "the old\\u200b"),
    ]
    for f in forms:
        assert leakage.words(f) == want, f


SENTENCE = "The quick brown fox jumps over the lazy dog. "


def n_words(text):
    return sum(map(len, prose.sentences(text)))


def test_prose_is_found_where_it_counts():
    body = "\n".join("// " + SENTENCE for _ in range(7))
    assert n_words(body + "\nint x = 3;") == 63
    assert n_words('"""\n' + SENTENCE * 7 + '\n"""\nimport os\n') == 63
    assert n_words("/**\n * " + SENTENCE + "\n * " + SENTENCE + "\n */\nf();") == 18
    assert n_words("<html><body><p>" + SENTENCE * 2 + "</p></body></html>") == 18
    assert n_words("# title\n\n" + SENTENCE * 3 + "\n\n```\nfoo bar baz qux.\n```\n") == 27


def test_other_text_is_no_prose():
    assert n_words('x = (\n "' + SENTENCE + '"\n "' + SENTENCE + '"\n)') == 0
    assert n_words('x = """\n' + SENTENCE * 7 + '\n"""\n') == 0
    assert n_words(json.dumps({"prompt": SENTENCE * 7})) == 0
    assert n_words("// see above\nimport os\nfor x in y: pass") == 0
    assert n_words(None) == n_words("") == 0


def corpus(rnd, level, n):
    words = {1: "cat dog sun red big", 2: "village market summer answer pleasant", 3: "reflectance calibration metadata threshold spectral", 4: "heteroscedasticity phenomenological disambiguation epistemology hermeneutic"}[level].split()
    return " ".join(" ".join([rnd.choice(["The", "A"]), *[rnd.choice(words) for _ in range(rnd.randrange(3, 5) + level)]]) + "." for _ in range(n))


def test_reading_levels(spark):
    rnd = random.Random(6)
    docs = [(i, corpus(rnd, 1 + i % 4, 25)) for i in range(160)] + [(500, None), (501, ""), (502, "x = 1"), (503, corpus(rnd, 1, 3))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 + i % 4) for i in range(0, 160) if i % 3] + [(1, 3), (999, 2), (None, 1), (3, None), (500, 1)], "doc_id long, reading_level int")
    got = {r[0]: r[1] for r in reading.grade(d, reading.fit(d, labels)).collect()}
    assert set(got) == set(range(160))
    held = [i for i in range(160) if i % 3 == 0]
    assert sum(got[i] == 1 + i % 4 for i in held) >= 0.9 * len(held)


def test_no_labels(spark):
    d = spark.createDataFrame([(1, SENTENCE * 9)], "doc_id long, text string")
    assert reading.grade(d, reading.fit(d, spark.createDataFrame([], "doc_id long, reading_level int"))).count() == 0


def test_training_takes_every_label(spark, monkeypatch):
    """The old bound is set low: no label may be left out because of it, on the driver or spread over tasks."""
    rnd = random.Random(8)
    docs = [(i, corpus(rnd, 1 + i % 4, 25 if i != 7 else 3)) for i in range(90)] + [(5, corpus(rnd, 2, 25)), (6, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1 + (i + (i % 11 == 0)) % 4) for i in range(60)] + [(4, 3), (8, 4), (8, 2), (8, 2), (999, 2)], "doc_id long, reading_level int")
    monkeypatch.setattr(reading, "MAX_TRAINING_DOCS", 8, raising=False)
    rated = {}
    for i, v in labels.collect():
        rated.setdefault(i, []).append(v)
    rows = sorted((i, t) for i, t in docs if i in rated and sum(map(len, prose.sentences(t))) >= reading.MIN_WORDS)
    whole = reading.Model([prose.sentences(t) for _, t in rows], [sum(rated[i]) / len(rated[i]) for i, _ in rows])
    want = sorted((i, int(v)) for i, t in docs if i != 7 and t for v in whole.levels([prose.sentences(t)]))
    for chars, parts in ((reading.DRIVER_CHARS if hasattr(reading, "DRIVER_CHARS") else 0, 3_000_000), (0, 20_000)):
        monkeypatch.setattr(reading, "DRIVER_CHARS", chars, raising=False)
        monkeypatch.setattr(reading, "TASK_CHARS", parts, raising=False)
        monkeypatch.setattr(reading, "ROWS", 50, raising=False)
        m = reading.fit(d, labels)
        assert m.vocabulary == whole.vocabulary and np.allclose(m.values, whole.values) and np.allclose(m.beta, whole.beta)
        assert sorted(tuple(r) for r in reading.grade(d, m).collect()) == want


def test_sentences_that_end_in_figures_or_brackets(spark):
    rnd = random.Random(9)
    texts = [(i, corpus(rnd, 1 + i % 4, 20)) for i in range(24)]
    odd = " ".join(f"The village market opened again (as in the summer of {k})." for k in range(1900, 1910))
    d = spark.createDataFrame([*texts, (100, odd), (101, odd.replace("(", "").replace(")", ""))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 + i % 4) for i in range(24)], "doc_id long, reading_level int")
    assert {100, 101} <= {r[0] for r in reading.grade(d, reading.fit(d, labels)).collect()}


def test_isotonic_map_is_monotone():
    rnd = random.Random(7)
    docs = [prose.sentences(corpus(rnd, 1 + i % 4, 20)) for i in range(60)]
    m = reading.Model(docs, [1.0 + i % 4 for i in range(60)])
    assert all(a <= b for a, b in zip(m.values, m.values[1:])) and all(a <= b for a, b in zip(m.cuts, m.cuts[1:]))


def test_word_pattern():
    assert re.findall(tokenize.PIECES, "a  b") == ["a", " ", " b"]
