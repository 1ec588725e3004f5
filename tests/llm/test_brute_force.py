"""Operators against plain versions of the same definitions over whole small tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tidelog.llm import byte_bpe, decontaminate, language_id, line_dedup, lm_score, quality, secrets, simhash_dedup, url_filter, warc
from tidelog.llm import queries as registered
from tidelog.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def got(spark):
    cache = {}

    def run(name):
        if name not in cache:
            cache[name] = [r.asDict() for r in registered.QUERIES[name](spark, SF).collect()]
        return cache[name]

    return run


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    expected = components(1100, edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {n: expected[n] for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_tokens(got, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(got("op1_byte_bpe"))
    for d in docs:
        ids = plain.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    coder = byte_bpe.Coder(tuple(byte_bpe.read_ranks(path)), public_tokenizers.PATTERN)
    r = random.Random(1)
    odd = ["", "".join(r.choice("etaoinshrdl") for _ in range(30_000)), "é" * 20_000, "a" * 3000, "ab" * 2000, "<|endoftext|>", " \n\n x ", "\x00\x01"] + ["".join(r.choice(letters) for _ in range(r.choice([3, 12, 60, 130, 300]))) for letters in ("ab", "etaoinshrdl ", "éèaou ünß", "=-+", "的是我一二") for _ in range(25)]
    ids, counts = coder.encode(odd)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [plain.encode_ordinary(t) for t in odd]
    assert coder.decode(ids, counts) == [t.encode() for t in odd]


def test_languages(got, docs):
    rows, held = by_id(got("op2_language_id")), [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(rows[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= rows[d["doc_id"]]["score"] <= 1 for d in docs)
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.95


def test_network_gradients():
    net = language_id.BiGru(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 5, (3, 6)).astype(np.int16), np.array([0, 2, 1])
    x[2, 4:] = language_id.PAD
    _, grad = net.gradients(x, y)
    for k, p in net.p.items():
        at = tuple(r.integers(0, s) for s in p.shape) if k != "e" else (1, int(x[0, 0]), 2)
        old, losses = p[at], []
        for step in (1e-4, -1e-4):
            p[at] = old + step
            losses.append(net.gradients(x, y)[0])
        p[at] = old
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(grad[k][at], rel=5e-3, abs=1e-6)
    net = language_id.BiGru(4)
    x = r.integers(0, 257, (50, language_id.WINDOW)).astype(np.int16)
    assert net.pooled(x) == pytest.approx(np.einsum("tnc,tn->nc", net.label(net.states(x)), (x.T != language_id.PAD).astype(np.float32)), abs=1e-4)


def simhash(text):
    words = WORD.findall(ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(got, docs):
    rows, ids = by_id(got("op3_simhash_dedup")), sorted(d["doc_id"] for d in docs)
    fp = {d["doc_id"]: simhash(d["text"]) for d in docs}
    root = components(len(ids), [(i, j) for i, a in enumerate(ids) for j in range(i) if (fp[a] ^ fp[ids[j]]).bit_count() <= 2])
    for i, a in enumerate(ids):
        assert (rows[a]["fingerprint"], rows[a]["component_id"]) == (f"{fp[a]:016x}", ids[root[i]])


def test_crowded_fingerprints(spark):
    """Large buckets are linked as all pairs within two bits are."""
    r = random.Random(5)
    fps = sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for c in (r.getrandbits(64) for _ in range(3)) for _ in range(120)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = dict(map(tuple, connected_components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()))
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    place = {i: k for k, i in enumerate(order)}
    root = components(len(fps), [(place[i], place[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [found.get(signed[i], signed[i]) for i in order] == [signed[order[root[place[i]]]] for i in order]


def test_quality(got, docs):
    rows = by_id(got("op4_quality_rules"))
    for d in docs:
        text = d["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        times = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(again) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_frequent_lines(spark):
    """Pages of one form, with as many lines and words each, share a banner; exact copies are one document."""
    banner = "Accept all of our cookies to read on, please, dear reader of this page"
    own = [(i, f"{banner}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "host") for i in range(200)]
    copy = " ".join(f"copy{j}" for j in range(40))
    only = [(1000, "\n".join([banner] * 2), "host"), (1001, f"{banner}\n" + "z " * 3 + banner, "elsewhere")] + [(2000 + i, copy, "host") for i in range(40)]
    df = spark.createDataFrame(own + only, "doc_id long, text string, source string")
    rows = {r["id"]: r for r in quality.judge(df).collect()}
    assert all(rows[i]["removed"] == [0] and rows[i]["kept"] for i in range(200))
    assert not rows[1000]["kept"] and rows[1001]["removed"] == [] and rows[2000]["kept"] and rows[2039]["kept"]
    kept = {r["doc_id"]: r["text"] for r in quality.keep_good(df).collect()}
    assert kept[3] == own[3][1].split("\n")[1] and 1000 not in kept


def test_line_verdicts(spark, docs):
    """removed and kept of every document of a table, with a limit that many lines are above."""
    lines = lambda t: [" ".join(WORD.findall(ascii_lower(x))) for x in (t or "").split("\n")]
    having = collections.defaultdict(set)
    for d in docs:
        for x in lines(d["text"]):
            having[d["lang"], x].add(d["text"])
    rows = {r["id"]: r for r in quality.judge(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in docs], "doc_id long, text string, source string"), line_docs=2, least_left=0.6).collect()}
    for d in docs:
        own = lines(d["text"])
        gone = [i for i, x in enumerate(own) if x and len(having[d["lang"], x]) > 2]
        n = sum(len(x.split()) for x in own)
        r = rows[d["doc_id"]]
        assert r["removed"] == gone and r["kept"] == (not r["base_failed"] and n - sum(len(own[i].split()) for i in gone) >= 0.6 * n)
    assert sum(bool(r["removed"]) for r in rows.values()) > 10


def test_urls(spark, got):
    rows = by_id(got("op5_url_filters"), "page_id")
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host = path = ""
        if "://" in (p["url"] or ""):
            rest = p["url"].split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], ascii_lower(host)
        rule = max((r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
        r = rows[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert r["verdict"] == rule[2] if rule else r["verdict"] in ("allow", "block")


def test_pagerank(spark):
    nodes = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("bad", 0.0, 1.0), ("friend", 0.0, 0.0)], "host string, good double, bad double")
    edges = spark.createDataFrame([("a", "b", 2), ("friend", "bad", 1), ("b", "friend", 1), ("b", "a", 3)], "src string, dst string, w long")
    got = {r["host"]: r for r in url_filter.spread(nodes, edges, tolerance=1e-9).collect()}
    names = ["a", "b", "bad", "friend"]
    w = np.zeros((4, 4))
    for s, t, n in edges.collect():
        w[names.index(s), names.index(t)] = n
    for column, seed, m in (("trust", [1, 0, 0, 0], w), ("distrust", [0, 0, 1, 0], w.T)):
        p = m / np.maximum(m.sum(1, keepdims=True), 1)
        exact = np.linalg.solve(np.eye(4) - url_filter.DAMPING * p.T, (1 - url_filter.DAMPING) * np.array(seed, float))
        assert [got[n][column] for n in names] == pytest.approx(exact, abs=1e-7)


def test_verdicts_over_links(spark):
    """Hosts without a rule get the verdicts that a dense solution of both ranks gives."""
    r = random.Random(9)
    hosts = [f"good{i}.org" for i in range(6)] + [f"bad{i}.com" for i in range(6)] + [f"host{i}.net" for i in range(40)]
    pages, w = [], np.zeros((len(hosts), len(hosts)))
    for k in range(400):
        s = r.randrange(len(hosts))
        near = [t for t in range(len(hosts)) if t != s and (s < 12 or t < 12 or (t - s) % 7 == 0)]
        to = [r.choice(near) for _ in range(r.randrange(3))] if s >= 6 else [r.randrange(6, 12)] * (r.random() < 0.1)
        for t in to:
            w[s, t] += 1
        path = "/de/x" if 6 <= s < 12 else "/x"
        pages.append((k, f"http://{hosts[s].upper()}{path}", " ".join(f'<a HREF="https://{hosts[t]}/p?{k}">' for t in to)))
    rows = {x["page_id"]: x for x in url_filter.op5_query(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    present = [any(p[1].lower().startswith(f"http://{h}/") for p in pages) for h in hosts]
    solve = lambda m, seed: np.linalg.solve(np.eye(len(hosts)) - url_filter.DAMPING * (m / np.maximum(m.sum(1, keepdims=True), 1)).T, np.array(seed, float))
    trust = solve(w, [i < 6 and present[i] for i in range(len(hosts))])
    distrust = solve(w.T, [6 <= i < 12 and present[i] for i in range(len(hosts))])
    expected = ["block" if distrust[i] > max(url_filter.LEAST_DISTRUST, url_filter.MARGIN * trust[i]) else "allow" for i in range(len(hosts))]
    sure = [min(abs(distrust[i] - url_filter.LEAST_DISTRUST), abs(distrust[i] - url_filter.MARGIN * trust[i])) > 1e-2 for i in range(len(hosts))]
    found = {rows[k]["host"]: rows[k]["verdict"] for k, _, _ in pages}
    unruled = [i for i in range(12, len(hosts)) if hosts[i] in found and sure[i]]
    assert {hosts[i]: found[hosts[i]] for i in unruled} == {hosts[i]: expected[i] for i in unruled}
    assert {"block", "allow"} == {expected[i] for i in unruled} and len(unruled) > 20
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    by_sql = {x[0]: x[4] for x in db.execute(registered.ORACLES["op5_url_filters"]).fetchall()}
    assert {k: by_sql[k] for k, _, _ in pages if found[rows[k]["host"]] != "allow" or by_sql[k] != "allow"} == {k: rows[k]["verdict"] for k, _, _ in pages if found[rows[k]["host"]] != "allow" or by_sql[k] != "allow"}


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql(got, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = db.execute(registered.ORACLES[name])
    names = [c[0] for c in found.description]
    own = got(name)
    assert sorted(names) == sorted(own[0]) and sorted(repr(tuple(r[c] for c in names)) for r in own) == sorted(map(repr, found.fetchall()))


def test_secrets(spark, got, docs):
    rows = by_id(got("op6_secret_scans"))
    assign = re.compile(secrets.BASE[0][1])
    for d in docs:
        text = d["text"] or ""
        spans = sorted([(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])
        line = ",".join(f"{secrets.BASE[k][0]}:{a}:{e}" for a, k, e in spans)
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_many_secrets(spark):
    """A text of more matches than one array of spans holds."""
    r = random.Random(2)
    words = [f"{r.getrandbits(80):020x}" if r.random() < 0.8 else "plain" for _ in range(1500)]
    text = " é ".join(words)
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["base"]
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer("[0-9a-f]{16,}", text)] and len(found) > 1000


def test_markov(spark):
    r = random.Random(4)
    draw = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(draw) for _ in range(32)) for _ in range(60)]
    names = ["getCustomerAccountBalanceById", "default_connection_timeout_seconds", "/usr/share/project/configuration/templates", "internationalisationHelperFactory", "MAXIMUM_TRANSACTION_RETRY_COUNT", "verantwortungsbewusstsein2024"] * 5
    df = spark.createDataFrame([(i, f"é x {t} token: {t[:4]}") for i, t in enumerate(keys + names)], "doc_id long, text string")
    rows = {x["id"]: x for x in secrets.find_secrets(df).collect()}
    caught = sum(any((s["start"], s["end"]) == (4, 36) for s in rows[i]["added"]) for i in range(60))
    assert caught >= 57 and not any(rows[i]["added"] for i in range(60, 60 + len(names)))
    inside = spark.createDataFrame([(1, f"password = {keys[0]}")], "doc_id long, text string")
    assert [len(x["added"]) for x in secrets.find_secrets(inside).collect()] == [0]


def normal(line):
    """Normal form of a line, character by character."""
    folded = "".join("0" if "0" <= c <= "9" else ascii_lower(c) for c in line)
    plain = "".join(c for c in folded if not ("!" <= c <= "~" and not c.isalnum()))
    words = WORD.findall(plain) or WORD.findall(folded)
    return " ".join(words)


def line_print(line):
    """SimHash of a normal form's features, bit by bit."""
    words = [w for w in line.split(" ") if len(w.encode()) > line_dedup.SHORT]
    if len(words) >= line_dedup.FEW_WORDS:
        h = [int(line_dedup.word_hashes(np.frombuffer(w.encode() + b"\n", np.uint8), np.arange(len(w.encode()) + 1) == len(w.encode()))[2][0]) for w in words]
    else:
        raw = line.encode() + b"\n" * line_dedup.GRAM
        grams = [int.from_bytes(raw[i : i + line_dedup.GRAM], "big") for i in range(max(1, len(line.encode()) - line_dedup.GRAM + 1))]
        h = [int(line_dedup.mix(np.array([g + 1], np.uint64))[0]) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def lost_lines(docs):
    """Line numbers that each document loses, from all pairs of lines; and the number of links."""
    occurrences = collections.defaultdict(list)
    for d in docs:
        for i, line in enumerate((d["text"] or "").split("\n")):
            if WORD.search(line):
                occurrences[normal(line)].append((d["doc_id"], i))
    lines = list(occurrences)
    fp = np.array([line_print(x) for x in lines], np.uint64)
    edges = [64 * i // line_dedup.BLOCKS for i in range(line_dedup.BLOCKS + 1)]
    links = []
    for i in range(len(lines)):
        differing = fp[:i] ^ fp[i]
        equal = sum(((differing >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1) == 0).astype(int) for lo, hi in zip(edges, edges[1:], strict=False))
        near = (np.bitwise_count(differing) <= line_dedup.LIMIT) & (equal >= line_dedup.BLOCKS - line_dedup.RADIUS)
        links += [(i, int(j)) for j in np.flatnonzero(near) if 1 - line_dedup.edit_distance(lines[i], lines[int(j)]) / max(len(lines[i]), len(lines[int(j)])) >= line_dedup.LEAST_SIMILARITY - 1e-9]
    groups = collections.defaultdict(list)
    for line, root in zip(lines, components(len(lines), links), strict=True):
        groups[root] += occurrences[line]
    lost = collections.defaultdict(list)
    for places in groups.values():
        for doc, i in sorted(places)[1:]:
            lost[doc].append(i)
    return {d["doc_id"]: ",".join(map(str, sorted(lost[d["doc_id"]]))) for d in docs}, len(links)


def test_lines(got, docs):
    lost, n = lost_lines(docs)
    assert n > 10 and lost == {r["doc_id"]: r["removed"] for r in got("op7_line_dedup")}


def test_crowded_lines(spark):
    """Large groups of lines, of which few are near the one that is tried first."""
    r = random.Random(11)
    rows = []
    for _ in range(3):
        words = [f"word{r.randrange(900)}" for _ in range(40)]
        for _ in range(90):
            rows.append(" ".join(words) + f"\n{r.randrange(10**6)}")
            words[r.randrange(40)] = f"word{r.randrange(900)}"
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(rows)]
    lost, n = lost_lines(docs)
    found = line_dedup.op7_query(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert n > 500 and lost == {x["doc_id"]: x["removed"] for x in found.collect()}


def test_line_forms():
    odd = ["", "a", "A\tB  c\r", " - - - ", "...x...", "\n\n", "é日本語テキスト 12", "w " * 700, "x" * 9000, "--\n \n!a!", "\x00\x01 \x0b"]
    data, start, end, counts = line_dedup.normalised([t.encode() for t in odd])
    raw = data.tobytes().decode()
    offset = {b: i for i, b in enumerate(np.cumsum([0] + [len(c.encode()) for c in raw]).tolist())}
    assert [raw[offset[s] : offset[e]] for s, e in zip(start.tolist(), end.tolist(), strict=True)] == [normal(x) for t in odd for x in t.split("\n")]
    assert counts.tolist() == [t.count("\n") + 1 for t in odd]
    some = start < end
    expected = [line_print(normal(x)) for t in odd for x in t.split("\n") if normal(x)]
    assert line_dedup.fingerprints(data, start[some], end[some]).view(np.uint64).tolist() == expected


def test_edit_distance():
    r = random.Random(2)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]
        assert all((line_dedup.edit_distance(a, b, most) <= most) == (row[-1] <= most) for most in range(8))


def leaks(docs, items):
    cut = set(decontaminate.PUNCTUATION)
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c for c in (t or "").lower() if c not in cut)) if w]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    out = {}
    for d, text in docs:
        w = words(text)
        s = shingles(w)
        for item, own in items:
            k = words(own)
            a = collections.Counter(shingles(k))
            for start in range(max(0, len(w) - len(k)) + 1 if w and a.keys() & set(s) else 0):
                b = collections.Counter(s[start : start + max(1, len(k) - 4)])
                common = sum((a & b).values())
                j = common / (sum(a.values()) + sum(b.values()) - common)
                if j >= 0.8 and j > out.get((d, item), (0,))[0]:
                    out[d, item] = (j, start)
    return out


def test_decontamination(spark, got, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = leaks([(d["doc_id"], d["text"]) for d in docs], items)
    assert {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in got("op8_decontamination")} == expected
    r = random.Random(6)
    mixed = []
    for n in range(120):
        words = r.choice(items)[1].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(["", "other", "two more"])
        mixed.append((n, " ".join(["before"] * r.randrange(9) + words + ["after"] * r.randrange(9))))
    found = decontaminate.op8_query(spark.createDataFrame(mixed, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (pytest.approx(x["similarity"]), x["start"]) for x in found} == leaks(mixed, items)


def test_windows_by_simhash_alone(spark, got, docs):
    """SimHashes of all windows, without a look at shared shingles first, lead to the same leaks."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    frame = spark.createDataFrame([(-1 - i, t) for i, t in items] + [(d["doc_id"], d["text"]) for d in docs], "id long, text string").where("text is not null")
    rows = decontaminate.with_shingles(frame.select("id", decontaminate.words_of(frame.text).alias("w")), "w", "own").select("id", decontaminate.F.size("w").alias("n"), "own").collect()
    sets = {r["id"]: (r["n"], np.array(r["own"], np.int64)) for r in rows}
    bits = lambda own: np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    found, near = set(), 0
    for d in docs:
        n, own = sets.get(d["doc_id"], (0, np.empty(0, np.int64)))
        if not n:
            continue
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(own), axis=0)])
        for item, _ in items:
            length, theirs = sets[-1 - item]
            if not length:
                continue
            m = min(max(1, length - 4), len(own))
            if length > n and m < len(own):
                continue
            prints = 2 * (sums[m:] - sums[:-m]) > m
            distance = (prints != (2 * bits(theirs).sum(0) > len(theirs))).sum(1)
            for s in np.flatnonzero(distance <= decontaminate.RADIUS).tolist():
                near += 1
                a, b = collections.Counter(theirs.tolist()), collections.Counter(own[s : s + m].tolist())
                common = sum((a & b).values())
                if common >= decontaminate.LEAST_SIMILARITY * (sum(a.values()) + sum(b.values()) - common):
                    found.add((d["doc_id"], item))
    assert near > 2 * len(found) > 0 and found == {(r["doc_id"], r["item_id"]) for r in got("op8_decontamination")}


def test_long_items(spark):
    """An item of more shingles than 16 bits count, in a text that goes on, and one that repeats a word."""
    r = random.Random(12)
    long = [f"w{r.randrange(3000)}" for _ in range(66_000)]
    items = [(1, " ".join(long)), (2, "so " * 300)]
    texts = [(1, "begin " + " ".join(long[:-20]) + " end of it " * 6), (2, "well " + "so " * 310 + "far"), (3, " ".join(reversed(long)))]
    found = decontaminate.op8_query(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"], x["start"]) for x in found} == {(1, 1, 0), (2, 2, 1)}


def test_language_model(got, docs):
    rows, train = by_id(got("op9_lm_scoring")), [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2]
    tokens = lambda d: [*WORD.findall(ascii_lower(d["text"])), None]
    count = collections.Counter(t for d in train for t in tokens(d))
    n, kinds = sum(count.values()), len(count)
    order, mark = lm_score.ORDER, 256
    symbols = lambda d: [mark] * order + list(ascii_lower(d["text"]).encode()) + [mark]
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for d in train:
        s = symbols(d)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][tuple(s[i - k : i])][s[i]] += 1

    def probability(context, x):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            own = {a: c for a, c in seen[k][tuple(context[order - k :])].items() if a not in out}
            if own:
                total = sum(own.values()) + (len(own) if len(out) + len(own) < 257 else 0)
                if x in own:
                    return p * own[x] / total
                p *= len(own) / total
                out |= own.keys()
        return p / (257 - len(out))

    for d in docs[:80]:
        r, s = rows[d["doc_id"]], symbols(d)
        own = sum(math.log10(probability(s[i - order : i], s[i])) for i in range(order, len(s)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(d)), sum(count[t] > 0 for t in tokens(d)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + kinds + 1)) for t in tokens(d)), rel=1e-9)
        assert r["score"] == pytest.approx(own, rel=1e-5)


def test_archive(spark, got, tmp_path):
    rows = by_id(got("op10_warc"), "page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    same = collections.defaultdict(list)
    for p in pages:
        same[(p["html"] or "").encode()].append(p["page_id"])
    for payload, ids in same.items():
        for i in ids:
            again = len(payload) >= 1000 and i != max(ids)
            assert rows[i] == {"page_id": i, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": max(ids) if again else None, "intact": True}
    twice = [(1, "http://h/\r\nx", "é" * 600), (2, None, "é" * 600), (3, "u", "short")]
    warc.write_archive(spark.createDataFrame(twice, "page_id long, url string, html string"), str(tmp_path / "a"))
    records = {r["page_id"]: r for r in warc.read_records(spark, str(tmp_path / "a")).collect()}
    assert {k: bytes(r["payload"]).decode() for k, r in records.items()} == {i: h for i, _, h in twice}
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    head, body = bytes(records[2]["record"]).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and body == ("é" * 600).encode() + b"\r\n\r\n" and b"Content-Length: 1200" in head
    assert records[1]["refers_to"] == 2 and bytes(records[1]["record"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def repeated_words(words):
    times = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}


def plain_pipeline(docs, items):
    """What is left of documents after the first four stages, as id and text."""
    lines = lambda t: [" ".join(WORD.findall(ascii_lower(x))) for x in t.split("\n")]
    having = collections.defaultdict(set)
    for d in docs:
        for x in lines(d["text"] or ""):
            having[d["source"], x].add(d["text"])
    good = []
    for d in docs:
        text = d["text"] or ""
        words, own = WORD.findall(text), lines(text)
        gone = {i for i, x in enumerate(own) if x and len(having[d["source"], x]) > quality.LINE_DOCS}
        if len(words) >= 20 and 100 * len(repeated_words(words)) <= 30 * len(words) and sum(len(x.split()) for i, x in enumerate(own) if i not in gone) >= quality.LEAST_LEFT * len(words):
            good.append({"doc_id": d["doc_id"], "text": "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)})
    lost = {k: set(map(int, filter(None, v.split(",")))) for k, v in lost_lines(good)[0].items()}
    for d in good:
        d["text"] = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in lost[d["doc_id"]])
    good.sort(key=lambda d: d["doc_id"])
    sets = []
    for d in good:
        words = WORD.findall(ascii_lower(d["text"]))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = components(len(good), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    first = [d for i, d in enumerate(good) if root[i] == i]
    leaked = {d for d, _ in leaks([(d["doc_id"], d["text"]) for d in first], items)}
    return {d["doc_id"]: d["text"] for d in first if d["doc_id"] not in leaked}


def test_whole_pipeline(spark, docs):
    import corpus_pipeline

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = plain_pipeline(docs, items)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert 100 < len(out) < len(docs) and out == {i: (plain.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in expected.items()}


@pytest.mark.parametrize("name", ["op3_simhash_dedup", "op4_quality_rules", "op7_line_dedup", "op8_decontamination", "op9_lm_scoring"])
def test_other_splits(spark, got, tmp_path, name):
    """Many small files and splits, and no adaptive execution, give the same rows."""
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(5).write.parquet(str(tmp_path / f"{table}.parquet"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [r.asDict() for r in registered.QUERIES[name](spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = lambda rows: sorted(rows, key=lambda r: (r["doc_id"], str(r.get("item_id"))))
    for a, b in zip(order(rows), order(got(name)), strict=True):
        assert a == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in b.items()}


def test_pipeline(spark, docs, got):
    import corpus_pipeline

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    coder = byte_bpe.Coder(tuple(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), public_tokenizers.PATTERN)
    bad = {r["doc_id"] for r in got("op4_quality_rules") if not r["kept"]}
    leaked = {r["doc_id"] for r in got("op8_decontamination")}
    assert not out.keys() & bad and len(out) > 0.6 * len(docs)
    firsts = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        firsts.setdefault(d["text"], d["doc_id"])
    copies = {d["doc_id"] for d in docs if firsts[d["text"]] != d["doc_id"]}
    left = {i for i in out.keys() & copies if coder.decode(np.array(out[i]["ids"], np.int32), np.array([out[i]["n_tokens"]]))[0].strip()}
    assert not left and sum(r["n_tokens"] == 0 for r in out.values()) <= 1  # of a copy, no line is left
    assert len(out.keys() & leaked) <= len(leaked) // 2  # a leak whose lines went with the line stage is no leak any more
    for r in out.values():
        (text,) = coder.decode(np.array(r["ids"], np.int32), np.array([len(r["ids"])]))
        assert hashlib.sha256(text).hexdigest() == r["decoded_sha256"]
