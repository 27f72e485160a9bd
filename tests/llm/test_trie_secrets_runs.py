"""Prefix trie, secret scan and periodic runs against plain versions, and their awkward rows."""

import hashlib
import random
import re
import zlib
from math import log2

import numpy as np
import pytest

from modelpulse.llm import periodic, prefix_trie, secret_scan

# --- trie -------------------------------------------------------------------------------------

TURN = "conv_id bigint, turn bigint, role string, text string, depth string, n string"


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by walking every prefix."""
    talk = {}
    for c, turn, role, text in rows:
        if c is not None:
            talk.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [t[2:] for t in sorted(x)] for c, x in talk.items()}
    rebuilt = {}
    for c, own in talk.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(talk.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def under(path):
        out = [path]
        for p in out:
            out += children.get(p, [])
        return out

    found = {}
    for path, cs in members.items():
        below = under(path)
        ends = sorted(c for c in cs if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        childless = sum(p not in children for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        found[min(cs), len(path)] = (
            parent, len(cs), len(children.get(path, [])), childless, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return found


def nodes_of(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], TURN)
    out = prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(table)).collect()
    found = {
        (r["conv_id"], r["depth"]): (
            r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]
        )
        for r in out
    }
    assert len(found) == len(out)
    return found


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(200, 230), 305, 1000, 1001]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ä€", "", None])))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("levels", [1_024, 3])
def test_trie_equals_walking_every_prefix(spark, monkeypatch, levels):
    """Also where conversations are deeper than a shard, which then hands sums up."""
    monkeypatch.setattr(prefix_trie, "LEVELS", levels)
    rows = conversations(levels)
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_one_conversation_told_by_all_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEVELS", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(400, 460) for t in range(4)]
    rows += [(700, t, "user", f"long {t}") for t in range(100)]
    rows += [(701, t, "user", f"long {t}") for t in range(60)]
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(spark.createDataFrame([], TURN))).count() == 0


def test_slots_are_all_taken_once_and_verified():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, 5_000, dtype=np.uint64) for _ in range(2))
    slots = prefix_trie.Slots(a, b)
    assert sorted(slots.slot.tolist()) == list(range(5_000))
    assert (slots.find(a, b) == slots.slot).all()
    assert (slots.find(b, a) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(a[[1, 1]], b[[1, 1]])


# --- secrets ----------------------------------------------------------------------------------


def plain_spans(text, only_base=False):
    """Spans by regular expressions and by counting every window anew."""
    text = text or ""
    spans = []
    assign = re.compile(
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    spans += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = list(secret_scan.BASE_KINDS)
    for no, c in enumerate(() if only_base else secret_scan.CHARSETS, 3):
        kinds.append(c.kind)
        for m in re.finditer(f"{c.pattern}{{{c.window},}}", text):
            body, covered = m[0], []
            if any(re.search(p, body) for p in secret_scan.ALLOWED):
                continue
            for f in range(len(body) - c.window + 1):
                part = body[f : f + c.window]
                bits = log2(c.window) - sum(part.count(x) * log2(part.count(x)) for x in set(part)) / c.window
                if bits < c.bits - 1e-7:
                    continue
                if covered and f <= covered[-1][1]:
                    covered[-1][1] = f + c.window
                else:
                    covered.append([f, f + c.window])
            spans += [(m.start() + f, no, m.start() + t) for f, t in covered]
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secret_texts():
    rng = random.Random(3)
    code = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexes, wide = "0123456789abcdef", secret_scan.CHARSETS[1].characters
    texts = [
        "", None, "   \n", "no secret here", 'token = "' + code(40, hexes) + '"', "PassWord:hunter2 and api_key=abcdefabcdef",
        "token=secret: abcdefghijklmnop", "apikey = '" + code(24, wide) + "'", "AKIAAKIA" + code(12, "ABC123") + " AKIA12",
        "é€😀 " + code(16, hexes) + " 😀 AKIA" + code(16, "ABCDEF01"), "c" * 200 + code(60, wide) + "d" * 100 + code(50, wide) + "=",
        "123e4567-e89b-12d3-a456-426614174000 " + "9" * 40, "EXAMPLE" + code(40, wide), "a/path/of/many/words/without/secrets/in/it",
        "secret: " + "ab" * 9, "\n".join(f"token={code(30, hexes)}" for _ in range(700)),
    ]
    return texts + [" ".join(code(rng.randrange(1, 70), rng.choice([hexes, wide, "abAB", "0123456789"])) for _ in range(30)) for _ in range(30)]


def test_secrets_equal_counting_every_window(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, SPANS string, scanned string")
    out = secret_scan.scan(docs)
    assert out.columns == ["doc_id", "text", "scanned", "base_spans", "spans"]
    shown = out.select("doc_id", "scanned", secret_scan.listed(out["base_spans"]).alias("b"), secret_scan.listed(out["spans"]).alias("s"))
    for r in shown.collect():
        assert r["b"] == plain_spans(texts[r["doc_id"]], True) and r["s"] == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["scanned"] == "y"
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_dense_strings_are_found_and_harmless_ones_left(spark):
    texts = [
        "key sk-9fK2mQx7LbT4vZ8nRw3YcJ6h end", "commit 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
        "Donaudampfschifffahrtsgesellschaftskapitän", "https://example.com/some/long/path/of/plain/words", "0123456789ABCDEF0123456789ABCDEF",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.scan(docs).collect()}
    assert spans[0] == ["base64_entropy"] and "hex_entropy" in spans[1]
    assert spans[2] == spans[3] == spans[4] == []


def test_a_very_long_candidate(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(30_000))
    out = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert out.select(secret_scan.listed(out["spans"])).first()[0] == plain_spans(text)


# --- runs -------------------------------------------------------------------------------------


def plain_runs(words):
    """Runs by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def word_lists(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(90))]
        if rng.random() < 0.7 and len(words) > 8:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(3, 10)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        if rng.random() < 0.3:
            words = words * 3 + words[: rng.randrange(len(words) + 1)]
        yield [b"w%d" % w for w in words]


def test_runs_equal_comparing_at_every_distance():
    lists = list(word_lists(1_500, 4))
    for words, found in zip(lists, periodic.runs_of_texts(lists)):
        assert found == plain_runs(words), words


@pytest.mark.parametrize("few", [0, 8])
def test_runs_at_one_border(monkeypatch, few):
    """Both ways to measure periods see all runs that hold the two words at the border."""
    monkeypatch.setattr(periodic, "FEW", few)
    for words in word_lists(60, 9):
        w = np.array([int(x[1:]) for x in words])
        for mid in range(1, len(w)):
            found = periodic.runs_at(w, 0, mid, len(w))
            assert sorted(found) == sorted(r for r in plain_runs(words) if r[0] < mid < r[1]), (words, mid)


def test_the_grammar_unfolds_to_its_words():
    for words in word_lists(300, 11):
        if not words:
            continue
        ids = [int(x[1:]) for x in words]
        g = periodic.Grammar(ids)

        def unfold(s):
            return [s] if s < g.base else unfold(g.rules[s - g.base][0]) + unfold(g.rules[s - g.base][1])

        assert [x for s in g.top for x in unfold(s)] == ids
        for k, (place, span) in enumerate(zip(g.places, g.spans)):
            assert unfold(g.base + k) == ids[place : place + span]


def test_long_texts():
    rng = random.Random(2)
    random_words = [b"%d" % rng.randrange(300) for _ in range(50_000)]
    one = [b"la"] * 50_000
    wound = [random_words[i % 7_000] for i in range(50_000)]
    blocks = [w for k in range(300) for w in [*[b"a"] * 100, b"b%d" % k]]
    found = periodic.runs_of_texts([random_words, one, wound, blocks])
    assert found[0] == [] and found[1] == [(0, 50_000, 1)] and found[2] == [(0, 50_000, 7_000)]
    assert found[3] == [(101 * k, 101 * k + 100, 1) for k in range(300)]


def test_runs_of_awkward_rows(spark):
    rows = [
        (1, "x " + "la " * 7 + "y", "k"), (1, "x " + "la " * 7 + "y", "k"), (2, None, "k"), (3, "", "k"), (4, " \t\n", "k"),
        (None, "a b a b a b a b c c c c c c", "k"), (5, "a b c d e f", "k"), (6, "a b " * 6, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, RUNS string")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_runs", "runs", "strongest", "collapsed"]
    found = out.collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert [tuple(r) for r in by_id[1]["runs"]] == [(1, 7, 1)] and by_id[1]["collapsed"] == "x la y"
    for i in (2, 3, 4):
        assert by_id[i]["n_runs"] == 0 and by_id[i]["strongest"] is None and by_id[i]["collapsed"] == ""
    assert [tuple(r) for r in by_id[None]["runs"]] == [(0, 8, 2), (8, 6, 1)]
    assert tuple(by_id[None]["strongest"]) == (8, 6, 1) and by_id[None]["collapsed"] == "a b c"
    assert by_id[5]["collapsed"] == "a b c d e f"
    # A blank of another kind doesn't part words.
    assert [tuple(r) for r in by_id[6]["runs"]] == [(0, 6, 1)]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, "RUNS")
