import random
import re

import pytest

from marketframe.llm import quality as q


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_counts(spark, docs, corpus):
    rng = random.Random(1)
    odd = ["a b c d e f g h " * 3, "a " * 40, "x\n" * 5 + "\n \n" * 3, "a\x0bb\x0cc d e", "é# ü* |<>&", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9", " ".join(rng.choice("ab") for _ in range(400))]
    rows = corpus + [(2000 + i, t, None, None, None) for i, t in enumerate(odd)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in q.judged(df).collect()}
    for i, text, *_ in rows:
        r = got[i]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_no_python_in_the_plan(docs):
    plan = q.judged(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_posteriors(rows, pseudo, first, first_share, rounds):
    """Expectation-maximisation row by row: the probability that each row is good."""
    n_rules = len(rows[0])
    share, tables = first_share, [{y: dict(first[y]) for y in (True, False)} for _ in range(n_rules)]
    good = []
    for _ in range(rounds):
        good = []
        for votes in rows:
            a, b = share, 1 - share
            for t, v in zip(tables, votes):
                a, b = a * t[True][v], b * t[False][v]
            good.append(a / (a + b))
        for j in range(n_rules):
            for y in (True, False):
                mass = {v: pseudo * first[y][v] for v in (-1, 0, 1)}
                for votes, p in zip(rows, good):
                    mass[votes[j]] += p if y else 1 - p
                tables[j][y] = {v: m / sum(mass.values()) for v, m in mass.items()}
        share = (sum(good) + pseudo * first_share) / (len(rows) + pseudo)
    out = []
    for votes in rows:
        a, b = share, 1 - share
        for t, v in zip(tables, votes):
            a, b = a * t[True][v], b * t[False][v]
        out.append(a / (a + b))
    return out


def planted(rng, n, rules=4):
    """Votes and truth: the first rule errs often, the others seldom."""
    rows, truth = [], []
    for _ in range(n):
        good = rng.random() < 0.85
        wrong = [0.3] + [0.05] * (rules - 1)
        votes = tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (-1 if rng.random() < w else 1) for w in wrong)
        rows.append(votes)
        truth.append(good)
    return rows, truth


def test_estimate_against_plain_loops():
    rows, truth = planted(random.Random(2), 1500)
    counts = {}
    for v in rows:
        counts[v] = counts.get(v, 0) + 1
    share, odds = q.estimate(sorted(counts.items()), 4)
    want = brute_posteriors(rows, q.PSEUDO_ROWS, q.FIRST, q.FIRST_SHARE, 200)
    got = [q.posterior(v, share, odds) for v in rows]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-5
    assert sum((p >= 0.5) == g for p, g in zip(got, truth)) / len(rows) > 0.95
    # the rule that errs often weighs least
    assert abs(odds[0][-1]) < min(abs(o[-1]) for o in odds[1:])
    # one objection of it is overruled, two of the others aren't
    assert q.posterior((-1, 1, 1, 1), share, odds) > 0.5 > q.posterior((1, -1, -1, 1), share, odds)


def test_quality_of_rows_against_plain_loops(spark):
    """The posteriors of whole texts, and verdicts that differ from those of passing every rule."""
    rng = random.Random(7)
    word = lambda: rng.choice("ab") * rng.randrange(1, 3) if rng.random() < 0.4 else "w" + "".join(rng.choice("aeiou") for _ in range(4))
    texts = []
    for i in range(300):
        words = [word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.randrange(30, 80))]
        kind = rng.random()
        if kind < 0.1:  # a table, otherwise clean
            words = [w + " |" if k % 6 == 0 else w for k, w in enumerate(words)]
        elif kind < 0.2:
            words = ["w" + "".join(rng.choice("aeiou") for _ in range(6)) + "###" for _ in words]
        elif kind < 0.25:
            words = ["LOUDER!!" for _ in words]
        elif kind < 0.3:  # a few rules abstain, none objects
            words = ["wordage" if k % 9 else "ab" for k, _ in enumerate(words[:25])]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = q.judged(df).orderBy("doc_id").collect()
    want = [1.0] * len(texts)
    for view in q.VIEWS.values():
        rows = [tuple(r[f"vote_{n}"] for n in view) for r in got]
        for i, p in enumerate(brute_posteriors(rows, q.PSEUDO_ROWS, q.FIRST, q.FIRST_SHARE, 500)):
            want[i] *= p
    assert max(abs(r.quality - w) for r, w in zip(got, want)) < 1e-4
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in got)
    objections = [sum(r[f"vote_{x.name}"] == -1 for x in q.RULES) for r in got]
    assert any(r.kept and n for r, n in zip(got, objections))


def test_verdicts(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(f"word{rng.randrange(5000)}" for _ in range(120)) + ".\nAnd a line."
    junk = lambda: " ".join(f"word{rng.randrange(5000)}###" for _ in range(120))
    rows = [(i, clean()) for i in range(200)] + [(1000 + i, junk()) for i in range(20)]
    got = {r.doc_id: r.kept for r in q.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(20))


def test_empty(empty):
    assert q.judged(empty).count() == 0
    assert q.estimate([], 1)[0] == pytest.approx(q.FIRST_SHARE)
