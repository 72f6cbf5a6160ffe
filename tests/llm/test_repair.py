import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marketframe.llm import entry, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
STEP = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else x
        h = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def best_repair(rows):
    """(cost, audit, repaired) of [(role, text, fault)] in order, by trying every edit at every row and state."""
    after = {s: (0, "", ()) if s in ("", "a") else None for s in STEP}

    def closed(now):
        for _ in range(4):
            for s in STEP:
                to = now[STEP[s]]
                if to is not None:
                    new = (to[0] + 2, "I" + to[1], ((NAME[STEP[s]], ""), *to[2]))
                    now[s] = min(now[s], new) if now[s] is not None else new
        return now

    now = closed(dict(after))
    for role, text, fault in reversed(rows):
        then, now = now, {}
        for s in STEP:
            ways = [(then[s][0] + 3, "D" + then[s][1], then[s][2])]
            if fault not in ("blank", "duplicate"):
                extra, first = int(fault == "truncated"), role[:1]
                if first == STEP[s] or (first == "s" and s == ""):
                    to = then[first]
                    ways.append((to[0] + extra, "K" + to[1], ((role, text), *to[2])))
                to = then[STEP[s]]
                ways.append((to[0] + extra + 2, "R" + to[1], ((NAME[STEP[s]], text), *to[2])))
            now[s] = min(ways)
        now = closed(now)
    return now[""]


def plain(rows, ids):
    out = {}
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(key(conv))}:{key(conv)}{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, marked, faults = set(), [], []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            faults.append(fault)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, kept = best_repair(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def key(conv):
    return "-" if conv is None else f"={conv}"


def made_up(rng, convs):
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 5, 8, 20])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "useless"])
            rows.append((c, rng.choice([t, t, t, None, t + 7]), role, rng.choice(["Yes.", "no", "Why?", "", " \n", "é!", "a. b", None])))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_against_all_edits(spark, monkeypatch, block):
    """Small blocks: nearly every conversation is cut in several."""
    rng = random.Random(block)
    rows = made_up(rng, [None, *range(60)]) + [(90, t, ("user", "assistant")[t % 2], "fine.") for t in range(40)]
    rows += [(91, None, None, None)] * 5 + [(92, 3, "user", "same.")] * 30
    monkeypatch.setattr(repair, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("conv", "id", "at", "block", "h", "r", "t", "same")})
    audits, kept = repair.repaired(df)
    sums = {r.conv: r.sha256 for r in repair.digests(kept).collect()}
    got = {r.conv: (*r[1:], sums.get(r.conv, hashlib.sha256(b"").hexdigest())) for r in audits.collect()}
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {key(c): v for c, v in plain(shown, {r[0] for r in rows}).items()}
    assert got == want
    assert {x for v in got.values() for x in v[6]} == set("DIKR")


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = made_up(rng, [None, *range(300)])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in entry.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain(damaged(rows), {r[0] for r in rows})
    assert any(v[6] == "" for v in got.values())


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert entry.op12_conversation_repair(spark, str(tmp_path)).count() == 0
