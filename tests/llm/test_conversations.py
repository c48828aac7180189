"""Repaired conversations against a plain search, and prefix tries against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from stopscan.llm import prefix_trie, structure_repair

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, kinds string, edits string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, edits) by uniform cost over whole edit strings: no estimate, no table of costs."""

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, edits, out
        if (at, state) in done:
            continue
        done.add((at, state))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        want = "a" if state == "u" else "u"
        given = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 5, edits + "I", at, want, out + (f"{given}:",)))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, state, out))
            if found[at] in ("", "truncated"):
                extra = 5 if found[at] else 0
                if role[:1] and role[:1] in fits:
                    heapq.heappush(heap, (cost + extra, edits + "K", at + 1, role[0],
                                          out + (f"{role}:{text}",)))
                heapq.heappush(heap, (cost + extra + 1, edits + "R", at + 1, want,
                                      out + (f"{given}:{text}",)))


def brute_audit(rows):
    found = faults(rows)
    cost, edits, out = cheapest(rows, found)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def check_audits(spark, frame):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute_audit(own) for c, own in damaged(rows).items()}
    found = {r[0]: tuple(r)[1:] for r in structure_repair.audits(frame).collect()}
    assert found == want


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why", "", None, "So. \t\n", "Ok?", "\x0b", f"n{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, 0]), role, text, "x", "y"))
    return rows


def test_audits_match_a_plain_search(spark):
    rows = random_rows(1, 300, 9)
    rows += [(None, 1, "user", "A.", None, None), (None, None, None, None, None, None),
             (-7, -3, "user", "long " * 50_000 + ".", None, None)]
    check_audits(spark, spark.createDataFrame(rows, SCHEMA))
    check_audits(spark, spark.read.parquet(f"{FOLDER}/conversations.parquet"))


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_a_conversation_are_repaired_apart(spark, monkeypatch, block):
    monkeypatch.setattr(structure_repair, "BLOCK", block)
    rows = random_rows(2, 30, 25) + [
        (99, t, ("user", "assistant")[t % 2 if t % 7 else 0], f"t{t % 90}" + "." * (t % 5 > 0), "", "")
        for t in range(300)]
    check_audits(spark, spark.createDataFrame(rows, SCHEMA))


def test_no_conversations(spark):
    assert structure_repair.audits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edits_are_applied():
    rows = [("system", "s"), ("user", ""), ("user", "q"), ("user", "r")]
    assert structure_repair.repaired(rows, "KDKRII") == [
        ("system", "s"), ("user", "q"), ("assistant", "r"), ("user", ""), ("assistant", "")]


def brute_trie(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    trie = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 4
        base = own.get(conv - (conv % 20 if conv >= 0 else -(-conv % 20)), [])
        path = tuple((r, t) for _, r, t in base[:head] + turns[head:])
        for depth in range(len(path) + 1):
            node = trie.setdefault(path[:depth], {"members": [], "ends": [], "children": set()})
            node["members"].append(conv)
            if depth < len(path):
                node["children"].add(path[:depth + 1])
        trie[path]["ends"].append(conv)
    leaves, saved = dict.fromkeys(trie, 0), dict.fromkeys(trie, 0)
    for path, node in trie.items():
        words = len(re.findall("[^\\x20\\x09-\\x0D]+", path[-1][1])) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not node["children"]
            saved[path[:depth]] += (len(node["members"]) - 1) * words
    return sorted((min(n["members"]), len(p), min(trie[p[:-1]]["members"]) if p else None,
                   len(n["members"]), len(n["children"]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
                  for p, n in trie.items())


def check_trie(spark, frame):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    found = sorted(tuple(r) for r in prefix_trie.nodes(frame).collect())
    assert found == brute_trie(rows)


def shared_rows(seed, conversations, longest, distinct):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            text = f"text {turn} " * rng.randrange(distinct) if turn < longest // 2 else str(rng.random())
            rows.append((conv * rng.choice([1, 1, 20]), rng.choice([turn, turn, None, 2]),
                         rng.choice(["user", None]), text, "x", "y"))
    return rows


def test_tries_match_brute_force(spark):
    rows = shared_rows(3, 400, 8, 3)
    rows += [(None, 1, "user", "x", None, None), (-7, None, None, None, None, None),
             (-47, 1, "user", "long " * 50_000, None, None)]
    check_trie(spark, spark.createDataFrame(rows, SCHEMA))
    check_trie(spark, spark.read.parquet(f"{FOLDER}/conversations.parquet"))


@pytest.mark.parametrize("chain", [1, 3])
def test_pieces_and_a_crowded_sketch_change_nothing(spark, monkeypatch, chain):
    """With few cells nearly all estimates are too high, and every node is still exact."""

    monkeypatch.setattr(prefix_trie, "CHAIN", chain)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", 4)
    rows = shared_rows(4, 60, 9, 2) + [(200 + 20 * k, t, "user", f"t{t if k < 2 or t < 30 else k}", "", "")
                                       for k in range(4) for t in range(50)]
    check_trie(spark, spark.createDataFrame(rows, SCHEMA))


def test_no_trie(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_estimate_is_never_below_the_count():
    rng = random.Random(5)
    keys = [hashlib.sha256(str(rng.randrange(900)).encode()).digest() for _ in range(1500)]
    sketch = prefix_trie.Sketch(1024)
    sketch.add(keys[:700])
    sketch.add(keys[700:])
    lone = sketch.lone(keys)
    assert all(keys.count(k) == 1 for k, v in zip(keys, lone) if v) and lone.any()
