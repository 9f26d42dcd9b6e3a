"""The training-data operators against brute force, round trips and the libraries they stand for."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import bloom_lm, byte_bpe, chat, components, cover_tree, mixing, neardup, pii, quality, queries, secrets, skew, token_files
from weft.llm.superminhash import WordHashes, shingle_set, signature
from weft.runtime import scratch_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, text2 string"


def frame(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, t, None, s, 1, "x", 0.5, None) for i, t, s in zip(ids or range(len(texts)), texts, sources or ["a"] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t ", "a", "word " * 30, "x" * 5000, "é😀 \n" * 40, "same text here again and again", "same text here again and again", "a b c d", None]


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text for r in table(spark, data, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, duck, name):
    same_rows(queries.QUERIES[name](spark, data), duck, queries.SQL[name])


# --- 1 and 6: spans ------------------------------------------------------------------------------

PLAIN_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
PLAIN_SECRETS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
    "access": (r"AKIA[A-Z0-9]+", lambda s: len(s) >= 20),
    "hex": (r"[0-9a-f]+", lambda s: len(s) >= 24),
}


def plain_spans(rules, text):
    found = []
    for rank, (kind, (pattern, keep)) in enumerate(rules.items()):
        for m in re.finditer(pattern, text):
            if keep(m[0]) if keep else len(m[2]) >= 6:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_pii_matches_plain_patterns(docs):
    rnd = random.Random(5)
    made = ["".join(rnd.choice("a.@+- ()0123459") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    made += ["a@b.c@d.e", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "x" * 3000 + "@", "+1 (523) 555-1055", "7" * 4000]
    for text in [*made, *docs.values()]:
        row = pii.pii_row(text)
        wanted = plain_spans(PLAIN_PII, text)
        assert row[4] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text[:80]
        assert set(wanted) <= set(row[5].split(","))


def test_pii_context_and_checksums():
    kinds = lambda t: [s.split(":")[0] for s in pii.pii_row(t)[5].split(",") if s]
    assert kinds("bank account GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("bank account GB83 WEST 1234 5698 7654 32") == []
    assert kinds("my SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 555-123-4567") == ["phone_local"] and kinds("sum 555-123-4567") == []


    assert kinds("bank account ES91 2100 0418 4502 0005 1332 EUR 12") == ["iban"] and kinds("IBAN ES9121000418450200051332 BIC ABCD") == ["iban"]
    assert kinds("bank REF AB12 CDEF GHIJ GB82 WEST 1234 5698 7654 32 IBAN") == ["iban"]
    assert kinds("Konto DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("téléphone 555-123-4567") == ["phone_local"]


def plain_added(text, base):
    """The method's own spans: each start tried in turn, each group end of an account number, against every base span."""
    out = []
    for d in pii.DETECTORS:
        at = 0
        while at < len(text):
            m, end = d.pattern.match(text, at), None
            if m and d.confirm:
                ends = [m.end(), *(k for k in range(m.end() - 1, at, -1) if text[k] == " ")]
                end = next((e for e in ends if 15 <= e - at and len(text[at:e].replace(" ", "")) <= 34 and pii.mod97(text[at:e])), None)
            elif m:
                end = m.end()
            if end and pii.score(d, text, at, end) >= pii.THRESHOLD and all(e <= at or s >= end for s, e, _ in base):
                out.append((at, end, d.kind))
            at = end or at + 1
    return sorted(out)


def test_pii_added_spans_match_brute_force(docs):
    rnd = random.Random(15)
    parts = ["a@b.co", "ssn", "123-45-6789", "bank", "REF AB12 CDEF GHIJ", "GB82 WEST 1234 5698 7654 32", "call", "555-123-4567", "+1 555 123 4567", "1.2.3.4", "part", "x" * 30, "4111 1111 1111 1111"]
    made = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    seen = collections.Counter()
    for text in [*made, *docs.values()]:
        base = pii.base_spans(text)
        found = sorted(x[:3] for x in pii.scored_spans(text, base))
        assert found == plain_added(text, base)
        seen.update(k for *_, k in found)
    assert set(seen) == {d.kind for d in pii.DETECTORS}


def test_pii_of_many_spans_takes_linear_time():
    def seconds(n):
        text, start = "a@b.co ssn 123-45-6789 " * n, time.process_time()
        pii.pii_row(text)
        return time.process_time() - start

    assert seconds(16_000) < 24 * max(seconds(1000), 0.005)


def test_pii_of_failing_proposals_takes_linear_time():
    def seconds(n):
        text, start = "AB12 CDEF GHIJ " * n, time.process_time()
        pii.pii_row(text)
        return time.process_time() - start

    assert seconds(16_000) < 24 * max(seconds(1000), 0.005)


def test_pii_query(spark, data, docs):
    for r in pii.op1_pii(spark, data).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.scored) == pii.pii_row(docs[r.doc_id] or "")


def test_secret_rules_added_to_the_base_kinds():
    kinds = lambda t: {s.split(":")[0] for s in secrets.secret_row(t)[4].split(",") if s} - set(secrets.BASE)
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,F0\n\nMIIB+a/b=\n-----END RSA PRIVATE KEY-----"
    hits = {
        "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-ab", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "private_key": key,
        "url_login": "https://me:pw@host/x", "access_temporary": "ASIA" + "A9" * 8, "service_key": "sk-" + "Ab-9" * 5, "npm": "npm_" + "aB3" * 8,
        "github_fine": "github_pat_" + "A_9" * 8, "bearer": "Bearer abc.def-ghi~123",
    }
    for kind, text in hits.items():
        assert kinds(f"x {text} y") == {kind}, kind
    for near in ("ghp_short", "xoxz-1234567890-ab", "eyJhb.eyJz.c2l", "-----BEGIN RSA PRIVATE KEY-----\nabc", "https://host/x@y", "ASIA123", "sk-short", "npm_x", "github_pat_1", "bearer of news"):
        assert not kinds(near), near
    text = key + "\n" + key.replace("END", "BEG") + key
    spans = [s for s in secrets.secret_row(text)[4].split(",") if s.startswith("private")]
    assert len(spans) == 2 and spans[0] == f"private_key:0:{len(key)}"


def test_secrets_query(spark, data, docs):
    for r in secrets.op6_secrets(spark, data).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == secrets.secret_row(docs[r.doc_id] or "")


def test_salted_join_deals_out_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    left = spark.createDataFrame([(k % 3 if k < 30 else 7, k) for k in range(100)], "key long, x long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "key long, y string")
    hot = skew.hot_keys_of(left, "key")
    assert [(r.key, r["__parts"]) for r in hot.collect()] == [(7, 7)]
    for how in ("inner", "left", "left_semi"):
        got, want = skew.salted_join(left, right, "key", hot, ["x"], how), left.join(right, "key", how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)


def test_secrets_match_plain_patterns(docs):
    rnd = random.Random(6)
    made = ["".join(rnd.choice(["token", "API_KEY", "Password", ":", "=", " ", '"', "a", "AKIA", "A9", "deadbeef", "ſecret", "toKen"]) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    for text in [*made, *docs.values()]:
        row = secrets.secret_row(text)
        wanted = plain_spans(PLAIN_SECRETS, text)
        assert row[3] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text[:80]


def test_odd_texts_through_the_span_operators(spark):
    for rows in (frame(spark, ODD), frame(spark, []), frame(spark, ODD, ids=[None] * len(ODD))):
        assert pii.find_pii(rows).count() == rows.count()
        found = secrets.scan_history(rows, scratch_path(spark, "l"))
        assert found.count() == rows.count()
        assert secrets.redact(rows, found).columns == rows.columns


def test_incremental_ledger(spark, data, duck):
    """Blobs are scanned once for each rule version, and a filled ledger gives what an empty one gives."""
    runs = {r.run: r for r in secrets.secrets_incremental(spark, data).collect()}
    whole = secrets.op6_secrets(spark, data)
    blobs, sums = whole.select("blob").distinct().count(), whole.agg(*(F.sum(f"n_{k}") for k in secrets.BASE)).first()
    assert runs[1].scanned + runs[2].scanned == runs[3].scanned == runs[2].in_ledger == blobs and 0 < runs[1].scanned < blobs
    assert tuple(runs[2])[4:] == tuple(runs[3])[4:] == tuple(sums) and runs[2].n_paths == runs[3].n_paths == whole.count()


def test_ledger_scans_only_what_is_new(spark):
    path = scratch_path(spark, "ledger")
    first = frame(spark, ["token = abcdef1", "clean", "token = abcdef1"])
    assert [r.n_assign for r in secrets.scan_history(first, path).orderBy("doc_id").collect()] == [1, 0, 1]
    assert spark.read.parquet(path).count() == 2
    again = frame(spark, ["clean", "token = zzzzzz9", "clean"])
    todo = secrets.unseen(again, secrets.ledger_at(spark, path), "doc_id", "text", secrets.RULE_VERSION).collect()
    assert [r.text for r in todo] == ["token = zzzzzz9"]
    assert [r.n_assign for r in secrets.scan_history(again, path).orderBy("doc_id").collect()] == [0, 1, 0]
    assert spark.read.parquet(path).count() == 3
    assert secrets.unseen(again, secrets.ledger_at(spark, path), "doc_id", "text", "next rules").count() == 2
    assert secrets.without("a token=bbbbbb c", "assign:2:14,hex:8:14", "#") == "a # c"


# --- 2: mixing -----------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = {s for s in open_ if rate * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: rate * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def plain_copies(rows, target):
    """Copies of (size, u) rows of one source: whole copies, certain ones, the ranked sample, one fill."""
    total = sum(s for s, _ in rows)
    if not total:
        return [0] * len(rows)
    whole = math.floor(target / total)
    room, merit = target - whole * total, lambda s: math.log2(s + 2)
    top, rate = None, 0.0
    for v in sorted({s for s, _ in rows if s}, reverse=True) if room > 0 else []:
        rest = sum(s * merit(s) for s, _ in rows if s <= v)
        r = (room - sum(s for s, _ in rows if s > v)) / rest
        if 0 <= r and r * merit(v) <= 1:
            top, rate = v, r
            break
    out = [whole if s else 0 for s, _ in rows]
    if top is None:
        return out
    left = room
    for k, (s, _) in enumerate(rows):
        if s > top:
            out[k], left = out[k] + 1, left - s
    if rate > 0:
        rank = lambda s, u: u / (1 - u) * (1 - min(1.0, rate * merit(s))) / min(1.0, rate * merit(s))
        by = collections.defaultdict(list)
        for k, (s, u) in enumerate(rows):
            if 0 < s <= top:
                by[rank(s, u)].append(k)
        for q in sorted(by):
            words = sum(rows[k][0] for k in by[q])
            if words > left:
                break
            left -= words
            for k in by[q]:
                out[k] += 1
    free = [(abs(left - s), u) for k, (s, u) in enumerate(rows) if s and out[k] < 2]
    if free:
        u = min(free)[1]
        mine = [k for k, r in enumerate(rows) if r[0] and r[1] == u and out[k] < 2]
        if abs(left - sum(rows[k][0] for k in mine)) < left:
            for k in mine:
                out[k] += 1
    return out


def test_mixing(spark, data):
    rnd = random.Random(2)
    texts = [" ".join(["w"] * rnd.choice([0, 5, 50, 50, 400])) for _ in range(600)] + [None, "a " * 20000]
    names = [rnd.choice(["hot"] * 6 + ["b", "é", "c", "ab", None]) for _ in texts]
    ids = [k // 2 for k in range(len(texts))]  # some rows are equal in id and text
    for df in (frame(spark, texts, sources=names), frame(spark, texts, ids=ids, sources=names), frame(spark, texts, ids=[None] * len(texts), sources=names), table(spark, data, "documents")):
        rows = mixing.mix_sources(df).collect()
        assert len(rows) == df.count()
        source = {(r.doc_id, r.u): r.source for r in df.withColumn("u", mixing.uniform(mixing.Mix().seed, "doc_id", "text")).collect()}
        by = collections.defaultdict(list)
        for r in rows:
            by[source[r.doc_id, r.u]].append(r)
        if len({(i, t, s) for i, t, s in zip(ids, texts, names)}) == len({(i, t) for i, t in zip(ids, texts)}) or df.columns[-1] != "text2":
            wanted = plain_targets({s: sum(r["size"] for r in x) for s, x in by.items()})
            for s, x in by.items():
                assert x[0].target == pytest.approx(wanted[s], rel=1e-9)
                taken = sum(r["size"] * r.copies for r in x)
                assert [r.copies for r in x] == plain_copies([(r["size"], r.u) for r in x], x[0].target)
                # whole documents: no nearer than half the longest one can be promised
                assert abs(taken - wanted[s]) <= max(0.02 * wanted[s], max(r["size"] for r in x) / 2)
                # expected words of the sample are the room that whole copies leave
                room = x[0].target - math.floor(x[0].target / max(1, x[0].source_size)) * x[0].source_size
                assert sum(r["size"] * r.pi for r in x) == pytest.approx(room, rel=1e-6, abs=1e-6)
        assert all(0 <= r.copies <= 2 for r in rows)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert {r.copies for r in mixing.mix_sources(frame(spark, [None, "", " "])).collect()} == {0}


def test_mixing_odds_are_kept_over_seeds(spark):
    """Documents are taken about as often as their inclusion odds say."""
    sizes = [3, 5, 8, 13, 21, 34, 55, 89] * 100
    df = frame(spark, [" ".join(["w"] * n) for n in sizes], sources=["a" if k % 3 else "b" for k in range(len(sizes))])
    seen, odds = collections.Counter(), collections.Counter()
    for seed in range(3):
        for r in mixing.mix_sources(df, mixing.Mix(seed=seed)).collect():
            whole = math.floor(r.target / r.source_size)
            seen[r["size"]] += r.copies - whole
            odds[r["size"]] += r.pi
    assert sum(seen.values()) == pytest.approx(sum(odds.values()), rel=0.05)
    assert all(seen[n] == pytest.approx(odds[n], abs=5 * math.sqrt(300 / 4)) for n in set(sizes))


# --- 3: quality ----------------------------------------------------------------------------------


def plain_statistics(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs):
    rnd = random.Random(3)
    made = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    texts = [t for t in ODD] + made + list(docs.values())[:60]
    rows = quality.statistics(frame(spark, texts)).orderBy("id").collect()
    for text, r in zip(texts, rows):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(text or ""), text


def test_quality_list_learns_and_keeps(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randint(0, 999)) for _ in range(40)) for _ in range(120)]
    bad = [" ".join("##" + w for w in g.split()) for g in good[:90]]
    df = frame(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < len(good)), 0) for k in range(len(good) + len(bad)) if k % 4], "doc_id long, quality int, toxic int")
    judged = quality.judge(df, labels).collect()
    assert all(r.kept == (r.doc_id < len(good)) for r in judged)
    assert all(not r.kept for r in quality.judge(frame(spark, ODD[:4]), labels.limit(0)).collect())
    assert quality.judge(frame(spark, []), labels).count() == 0
    assert all(r.kept for r in quality.judge(frame(spark, good), labels.limit(0)).collect())


def test_quality_on_held_out_labels(spark, data):
    labels = table(spark, data.replace("sf0.001", "sf0.01"), "labels")
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    judged = quality.judge(docs, labels.filter("doc_id % 2 = 0")).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    right, total = judged.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first()
    assert right >= 0.95 * total


def plain_cover(rows, edges):
    """Rules as lists of (feature, above, bin), grown and pruned over (bins, bad, part) rows in memory."""
    meets = lambda r, rule: all((r[0][f] > b) == above for f, above, b in rule)
    rules = []
    while len(rules) < quality.MAX_RULES:
        rule, inside = [], [r for r in rows if r[2] < 2]
        while len(rule) < quality.MAX_CONDITIONS:
            bad = sum(r[1] for r in inside)
            if not bad or bad == len(inside):
                break
            best = None
            for f in range(len(edges)):
                for b in range(len(edges[f])):
                    for above in (False, True):
                        x = [r for r in inside if (r[0][f] > b) == above]
                        p = sum(r[1] for r in x)
                        gain = p * (math.log2(p / len(x)) - math.log2(bad / len(inside))) if p else 0.0
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (f, above, b))
            if best is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if meets(r, rule)]
        worth = []
        for k in range(len(rule)):
            x = [r for r in rows if r[2] == 2 and meets(r, rule[: k + 1])]
            p = sum(r[1] for r in x)
            worth.append(((2 * p - len(x)) / max(1, len(x)), -k, p, len(x)))
        if not worth:
            break
        _, k, p, n = max(worth)
        if p < quality.LEAST or p < quality.PRECISION * n:
            break
        rules.append(rule[: 1 - k])
        rows = [r for r in rows if not meets(r, rules[-1])]
    return rules


def test_quality_list_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(21)
    kinds = [lambda w: w, lambda w: "##" + w, lambda w: w.upper() + "!!", lambda w: w + "9999"]
    texts, marks = [], []
    for k in range(360):
        kind = k % 6 if k % 6 < 4 else 0
        texts.append(" ".join(kinds[kind](rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99))) for _ in range(rnd.randint(12, 60))))
        marks.append(int(kind == 0) if rnd.random() > 0.02 else rnd.randint(0, 1))
    labels = spark.createDataFrame([(k, m, 0) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    seen = []
    binned = quality.binned
    monkeypatch.setattr(quality, "binned", lambda *a: seen.append(binned(*a)) or seen[-1])
    stats = quality.statistics(frame(spark, texts))
    learned = quality.learn(stats, labels)
    rows, edges = seen[0]
    rows = [(r.bins, r.bad, r.part) for r in rows.collect()]
    assert [[(c.feature, c.above, c.bin) for c in r] for r in learned.rules] == plain_cover(rows, edges)
    assert learned.rules
    numbered = {r.id: r.rule for r in stats.withColumn("rule", learned.rule()).collect()}
    values = {r.id: r for r in stats.collect()}
    meets = lambda r, rule: all((r[quality.FEATURES[c.feature]] > c.threshold) == c.above for c in rule)
    assert all(n == next((k for k, rule in enumerate(learned.rules, 1) if meets(values[i], rule)), 0) for i, n in numbered.items())


def test_quality_query(spark, data, docs):
    for r in quality.op3_quality(spark, data).collect():
        n, *rest = plain_statistics(docs[r.doc_id] or "")
        failed = n < 10 or 100 * rest[-1] > 20 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, *rest, failed)
        assert r.kept == (not failed and r.rule == 0)


def test_mixing_query(spark, data):
    rows = {r.doc_id: r for r in mixing.mix_sources(table(spark, data, "documents")).collect()}
    for r in mixing.op2_mixing(spark, data).collect():
        m = rows[r.doc_id]
        assert (r["size"], r.source_size, r.target, r.taken) == (m["size"], m.source_size, m.target, m["size"] * m.copies)
        assert r.taken <= 2 * r["size"]


# --- 4: near-duplicates --------------------------------------------------------------------------


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


@pytest.mark.parametrize("small", [1, 16])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # 1: every open bucket goes the way of large ones
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rnd = random.Random(small)
    base = [[f"w{rnd.randint(0, 9999)}" for _ in range(60)] for _ in range(4)]
    texts = list(ODD)
    for b in base:
        for _ in range(25):
            c = list(b)
            for _ in range(rnd.randint(0, 3)):
                c[rnd.randrange(60)] = f"x{rnd.randint(0, 9999)}"
            texts.append(" ".join(c) if rnd.random() < 0.5 else " \n".join(c).upper())
    rows = neardup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == plain_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    rows = neardup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f"], ids=[7, 7])).collect()
    assert [(r.component_id, r.kept) for r in rows] == [(7, True)] * 2


def test_superminhash_estimates(spark):
    h, errors = WordHashes(), []
    for k in range(60):
        a = [f"{k}-{i}" for i in range(300)]
        b = a[:240] + [f"{k}+{i}" for i in range(60)]
        x, y = (shingle_set(" ".join(t), h) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((signature(x, 128) == signature(y, 128)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.1 * math.sqrt(0.66 * 0.34 / 128)
    few = np.array([5], np.uint64)
    assert sorted(np.floor(signature(few, 16))) == list(range(16))
    assert np.isinf(signature(few[:0], 8)).all()


def test_size_classes_hold_all_links(spark):
    pairs = [(m, n) for m in [*range(1, 400), 3**12, 3**15, 10**6 + 1] for n in {m, 4 * m // 3, max(m, 4 * m // 3 - 1)}]
    df = spark.createDataFrame(pairs, "m long, n long")
    assert df.filter(F.abs(neardup.size_class(F.col("m")) - neardup.size_class(F.col("n"))) > 1).isEmpty()


def test_links_in_block():
    """Rare shingles name every link that a comparison of all pairs finds, also where most shingles are shared by all."""
    rnd = np.random.default_rng(8)
    common = rnd.integers(-(1 << 62), 1 << 62, 60)
    sets = []
    for k in range(120):
        base = np.union1d(rnd.choice(common, rnd.integers(0, 50), replace=False), rnd.integers(-(1 << 62), 1 << 62, rnd.integers(1, 40)))
        sets += [base] + [np.union1d(rnd.choice(base, max(1, int(len(base) * f)), replace=False), rnd.choice(common, 1)) for f in (0.75, 0.8, 0.9)]
    order = [(0, k) for k in range(0, len(sets), 2)] + [(1, k) for k in range(len(sets))]
    roots = [bytes([rnd.integers(0, 9)]) for _ in sets]
    names = [b"%04d" % k for k in range(len(sets))]
    columns = {"side": [s for s, _ in order], "node": [names[k] for _, k in order], "root": [roots[k] for _, k in order]}
    columns["packed"] = [sets[k].astype(np.int64).tobytes() for _, k in order]
    got = neardup.links_in_block(pa.table(columns))
    links = set(zip(got.column("u").to_pylist(), got.column("v").to_pylist()))
    want = set()
    for o in range(0, len(sets), 2):
        for k in range(len(sets)):
            inter = len(np.intersect1d(sets[o], sets[k]))
            if roots[o] != roots[k] and 100 * inter >= 75 * (len(sets[o]) + len(sets[k]) - inter):
                want.add(tuple(sorted((names[o], names[k]))))
    assert links == want and len(want) > 50


def test_components_of_hubs(spark, monkeypatch):
    """Nodes of many edges, and roots of many nodes, are dealt out to several tasks."""
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "MOST", 50)
    edges = [(1000 * h, 1000 * h + k) for h in range(1, 4) for k in range(1, 200)] + [(1005, 2005), (7, 8), (8, 9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(len, groups.values())) == [3, 200, 400] and set(got) == {x for e in edges for x in e}


def test_components(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(50)] + [(rnd.randint(2000, 2200), rnd.randint(2000, 2200)) for _ in range(90)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    label = {x: x for e in edges for x in e}
    for u, v in edges:
        a, b = sorted((label[u], label[v]))
        label = {x: a if y == b else y for x, y in label.items()}
    groups = lambda m: {frozenset(x for x in m if m[x] == y) for y in m.values()}
    assert groups(got) == {g for g in groups(label) if len(g) > 1}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 5 and 10: tokens ----------------------------------------------------------------------------

ALPHABET = "ab AB  \n\n\t\r\x0b\x1c\x85\u00a0\u2003'sé日本😀1२,.!|-<|endoftext|>\u0301\u200b"


def made_texts(n):
    rnd = random.Random(8)
    return ["".join(rnd.choice(ALPHABET if k % 2 else "ab \n,.é\t|") for _ in range(rnd.randint(0, 25))) for k in range(n)]


def hugging():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_bpe.vocabulary_path(token_files.VOCABULARY))
    tok.encode_special_tokens = True
    return tok


def test_segment_codes_equal_the_library(docs):
    texts, tok = made_texts(4000) + list(docs.values())[:80], hugging()
    codes = token_files.encoder(byte_bpe.vocabulary_path(token_files.VOCABULARY))[0]
    for x, y in zip(codes.of(texts), tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(x, "<u2").tolist() == y.ids


def test_byte_bpe_equals_the_library(docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = byte_bpe.vocabulary_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = byte_bpe.ByteBpe(path)
    for t in [*made_texts(4000), *list(docs.values())[:80]]:
        ids = mine.encode(t)
        assert ids == enc.encode_ordinary(t) and mine.decode(ids) == t.encode()
        n, a, b = byte_bpe.digests(mine, pa.array([t]))[0]
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("vocabulary", [2, 256, 1000, 50257, 65536, 70000])
def test_bit_packing(vocabulary):
    bits = token_files.bits_for(vocabulary)
    assert (1 << bits) >= vocabulary > (1 << bits) // 2 or vocabulary == 2
    ids = np.random.default_rng(1).integers(0, vocabulary, 2500)
    for n in (0, 1, 1023, 1024, 1025, 2500):
        payload, offsets = token_files.pack(ids[:n], bits)
        assert len(payload) <= -(-n // 1024) + n * bits / 8 + 1
        for s, e in ((0, n), (min(n, 7), n), (min(n, 1020), min(n, 1030)), (n, n)):
            assert token_files.unpack(payload, offsets, bits, s, e).tolist() == ids[s:e].tolist()


def test_token_file_ranges_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 1000)
    rows = spark.createDataFrame([("é" * 500,)] * 41 + [(None,)], "text string")
    assert token_files.ranges_of(rows) == 41 and token_files.ranges_of(rows.filter("false")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_token_files(spark):
    texts = [*ODD, *made_texts(300)]
    ids = random.Random(1).sample(range(-50, 5000), len(texts))
    out, path, tok = scratch_path(spark, "t"), byte_bpe.vocabulary_path(token_files.VOCABULARY), hugging()
    token_files.write_token_files(frame(spark, texts, ids=ids), out, path, parts=9)
    shards = token_files.read_token_files(spark, out)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(shards).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts)):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    want = [*tok.encode(texts[5], add_special_tokens=False).ids, 2]
    assert token_files.read_document(shards, ids[5]).tolist() == want and token_files.read_document(shards, 9999) is None
    for k in range(0, len(ids), 17):
        assert len(token_files.read_document(shards, ids[k])) == got[ids[k]][1]
    assert token_files.read_document(shards, min(i for i in ids if i is not None) - 1) is None
    for rows in (frame(spark, []), frame(spark, ["a", "b", "a"], ids=[None, 3, None]), frame(spark, [f"{k} x" for k in range(200)], ids=[7] * 200)):
        out = scratch_path(spark, "t")
        token_files.write_token_files(rows, out, path, parts=3)
        back = token_files.read_token_files(spark, out)
        found = token_files.read_digests(back).orderBy("start").collect()
        assert len(found) == rows.count() and [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    assert back.select("range").distinct().count() > 1  # rows of one id are dealt out


def test_token_queries(spark, data, docs):
    """The queries of operators 5 and 10 against the libraries themselves."""
    import base64

    import public_tokenizers
    import tiktoken

    tok, start = hugging(), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op5_token_files(spark, data).collect()}
    for i in sorted(docs):
        want = np.array([*tok.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.op10_byte_bpe(spark, data).collect():
        ids = enc.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_segments_whose_ids_cannot_be_told_apart():
    """Where a vocabulary doesn't tell where segments start, each is encoded alone."""
    tok = hugging()
    codes = token_files.JoinedCodes(*token_files_parts(tok))
    codes.spaced = np.zeros_like(codes.spaced)
    found = codes.joined(["12", "a1", "=="], " ")
    assert [np.frombuffer(x, codes.dtype).tolist() for x in found] == [tok.encode(" " + s, add_special_tokens=False).ids for s in ("12", "a1", "==")]


def test_segments_through_small_memories(docs):
    """Ids stay right when the generations of remembered segments are dropped all the time, and over runs of texts."""
    texts, tok = [*list(docs.values())[:60], None, "", *made_texts(300)], hugging()
    codes = token_files.JoinedCodes(*token_files_parts(tok))
    codes.limit = 50
    out = []
    for some in (texts[:40], texts[40:]):
        for ids, sizes in codes.runs(pa.array(some, pa.string())):
            ends = np.cumsum(sizes)
            out += [ids[e - n : e].tolist() for n, e in zip(sizes, ends)]
    assert out == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def token_files_parts(tok):
    byte = {c: b for b, c in enumerate(byte_bpe.byte_characters())}
    return tok, [bytes(byte.get(c, 0) for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())]


# --- 7: search -----------------------------------------------------------------------------------


def plain_top(rows, queries_, k):
    out = []
    for qi, q in queries_:
        fine = [(i, v) for i, v in rows if i != qi and len(v) == len(q)]
        found = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, v)), i) for i, v in fine)
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + 0.1 * rnd.normal(size=12)]) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(40)] + [(4000, [0.0] * 12), (4100, [1.0, 2.0]), (6000, []), (6001, [])]
    odd = [(5000, None), (5100, [None] + [0.0] * 11), (5200, [float("nan")] * 12), (5300, [float("inf")] * 12), (None, [9.0] * 12)]
    df = spark.createDataFrame(rows + odd, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])).withColumn("score", F.lit("x"))
    got = sorted(map(tuple, cover_tree.top_k(df.filter("vec_id % 100 = 0"), df).collect()))
    assert got == plain_top(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert cover_tree.top_k(df.limit(0), df).count() == 0 and cover_tree.top_k(df, df.limit(0)).count() == 0


def test_top_k_prunes_and_stays_exact(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = np.floor(1024 * (rnd.normal(size=(40, 8))[np.arange(2000) % 40] + 0.01 * rnd.normal(size=(2000, 8))))
    s = cover_tree.Search(np.arange(50), x[:50], np.arange(2000), x, 5)
    s.walk(cover_tree.tree(x[:50], 0), cover_tree.tree(x))
    assert s.compared < 0.6 * 50 * 2000
    big = cover_tree.exact_scores(np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [1.0, 1.0]]))
    assert big == [[(1 << 63) - 1, (1 << 40) + 3]]
    # over several nodes and parts: clustered vectors are compared with few others
    monkeypatch.setattr(cover_tree, "ROWS", 20)
    monkeypatch.setattr(cover_tree, "PART", 2000)
    rows = [(i, v) for i, v in enumerate((x / 1024).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cover_tree.hits_of(df.filter("vec_id % 20 = 0"), df, 5).cache()
    compared, pairs = found.agg(F.sum("compared"), F.sum("pairs")).first()
    assert pairs < 0.3 * 100 * 2000 and compared <= pairs
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.best_first(found, 5).collect())
    assert got == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_top_k_of_huge_components(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PART", 200)
    rnd = random.Random(12)
    rows = [(i, [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(0, 60) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = lambda x: min((1 << 63) - 1, max(-(1 << 63), x))
    want = []
    for qi, q in rows[::20]:
        best = sorted((-held(sum(int(1024 * a) * int(1024 * b) for a, b in zip(q, v))), i) for i, v in rows if i != qi)[:10]
        want += [(qi, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, cover_tree.top_k(df.filter("vec_id % 20 = 0"), df).collect())) == want


# --- 8: language model ---------------------------------------------------------------------------


def plain_scores(texts, held):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) with exact levels instead of a filter's."""
    tokens = [(t or "").encode().lower().split() + [0] for t in texts]
    c = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    pairs = collections.Counter(p for ws, h in zip(tokens, held) if not h for p in zip([0, *ws], ws))
    n, v = sum(c.values()), len(c)
    about = lambda x: (2 ** (x.bit_length() - 1) + 2 ** x.bit_length() - 1) / 2 if x else 0.0
    uni = lambda x: (x + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for ws, h in zip(tokens, held):
        lm = 0.0
        for p, w in zip([0, *ws], ws):
            before = about(c[p])
            lm += math.log10(min(1.0, (min(about(pairs[p, w]), before) + bloom_lm.PRIOR * uni(about(c[w]))) / (before + bloom_lm.PRIOR)))
        out.append((h, len(ws), sum(w in c for w in ws), n, sum(math.log10(uni(c[w])) for w in ws), lm))
    return out


def scores(docs, held, **more):
    return sorted((tuple(r) for r in bloom_lm.score_documents(docs, held, **more).collect()), key=lambda r: repr(r))


@pytest.mark.parametrize("bits", [bloom_lm.BITS, 0])
def test_language_model_equals_brute_force(spark, data, docs, bits):
    """The broadcast filter and one that stays with its segments; 60 bits an entry leave no false answers."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = sorted(map(tuple, bloom_lm.score_documents(table(spark, data, "documents"), out, bits=bits, per_entry=60).collect()))
    ids = sorted(docs)
    for r, i, want in zip(got, ids, plain_scores([docs[i] for i in ids], [held(i) for i in ids]), strict=True):
        assert r[:5] == (i, *want[:4]) and r[5:] == pytest.approx(want[4:], rel=1e-9)


def test_language_model_query(spark, data, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = sorted(docs)
    want = plain_scores([docs[i] for i in ids], [held(i) for i in ids])
    got = sorted(map(tuple, bloom_lm.op8_lm(spark, data).collect()))
    for r, i, w in zip(got, ids, want, strict=True):
        assert r[:5] == (i, *w[:4]) and r[5] == pytest.approx(w[4], rel=1e-9) and r[6] == pytest.approx(w[5], rel=0.05)
    # 9 bits an entry: levels are sometimes read too high, which moves sums little
    assert sum(r[6] for r in got) == pytest.approx(sum(w[5] for w in want), rel=0.01)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])
    # a filter that isn't broadcast reads the same bits
    assert scores(table(spark, data, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, bits=0) == sorted(got, key=repr)


def test_bloom_levels():
    rnd = np.random.default_rng(0)
    keys, level = np.unique(rnd.integers(0, 1 << 63, 20000).astype(np.uint64)), None
    level = bloom_lm.levels_of(rnd.zipf(1.5, len(keys)))
    assert level.min() == 1 and bloom_lm.levels_of(np.array([0, 1, 2, 3, 4, 1 << 40])).tolist() == [0, 1, 2, 2, 3, 41]
    bits = bloom_lm.built(keys, level, bloom_lm.PER_ENTRY)
    assert len(bits) * 8 <= level.sum() * bloom_lm.PER_ENTRY + 64
    got = bloom_lm.probe(bits, keys, 0, len(bits) * 8)
    assert (got >= level).all() and (got > level).mean() < 0.03
    missing = bloom_lm.probe(bits, rnd.integers(1 << 63, (1 << 64) - 1, 20000, dtype=np.uint64), 0, len(bits) * 8)
    assert (missing > 0).mean() < 0.03
    for k in (keys[:0], keys[:1], keys):
        assert (bloom_lm.unpack(bloom_lm.pack(k)) == k).all()
    for x in (level[:0], level, level.astype(np.int64) << 50):
        assert (bloom_lm.unplanes(bloom_lm.planes(x)) == x).all()


def test_language_model_rows_follow_runs_not_segments(spark, data, docs, monkeypatch):
    """65,536 segments: the same runs, so the same rows are sent; scores are those of brute force on both ways.

    Segments of few entries need more bits for each to have no false answers.
    """
    tokens = sum(len((t or "").encode().split()) + 1 for t in docs.values())
    few = bloom_lm.Layout.of(tokens, 8)
    assert few == bloom_lm.Layout(256, 8, 8)
    monkeypatch.setattr(bloom_lm, "SEGMENT_TOKENS", tokens / 65_000)
    many = bloom_lm.Layout.of(tokens, 8)
    assert many == bloom_lm.Layout(65_536, 8, 8)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out, ids = F.crc32(F.col("doc_id").cast("string")) % 5 == 1, sorted(docs)
    want = plain_scores([docs[i] for i in ids], [held(i) for i in ids])
    for bits in (bloom_lm.BITS, 0):
        got = sorted(map(tuple, bloom_lm.score_documents(table(spark, data, "documents"), out, bits=bits, per_entry=600).collect()))
        for r, i, w in zip(got, ids, want, strict=True):
            assert r[:5] == (i, *w[:4]) and r[5:] == pytest.approx(w[4:], rel=1e-9)


def test_language_model_layout():
    for tasks in (1, 3, 8, 200, 5000):
        for tokens in (0, 10**6, 10**9, 10**11, 10**14):
            x = bloom_lm.Layout.of(tokens, tasks)
            assert x.segments % x.runs == 0 and x.segments * bloom_lm.SEGMENT_TOKENS >= tokens and 1 <= x.tasks <= x.runs
            assert x.runs * bloom_lm.RUN_TOKENS >= tokens and -(-x.runs // x.tasks) <= 4
            assert x.tasks >= min(tasks, x.runs)


@pytest.mark.parametrize("runs", [1, 8, 256])
def test_language_model_segments_of_a_run(runs):
    """The segments that runs make are those that a cut of all keys makes."""
    rnd, layout = np.random.default_rng(4), bloom_lm.Layout(256, runs, runs)
    words, pairs = (np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (3000, 5000))
    level = {len(k): bloom_lm.levels_of(rnd.zipf(1.5, len(k))) for k in (words, pairs)}
    got, cuts = [], [bloom_lm.cut(k, bloom_lm.Layout.shift(runs)) for k in (words, pairs)]
    for run in range(runs):
        entries = [(k[places[run]], level[len(k)][places[run]]) for k, (_, places) in zip((words, pairs), cuts)]
        got += bloom_lm.segments_of(layout, run, entries, 9)
    want = [np.concatenate([x[k >> np.uint64(56) == s] for k in (words, pairs) for x in ([k, level[len(k)]][i],)]) for s in range(256) for i in (0, 1)]
    for s in range(256):
        assert (got[s] == bloom_lm.built(want[2 * s], want[2 * s + 1], 9)).all()


def test_language_model_of_odd_texts(spark):
    long = " ".join(f"w{k % 70000}" for k in range(150_000))
    for texts, ids in ((ODD, None), (ODD, [None] * len(ODD)), ([], None), ([long, " x \x0b", long, "İ K A"], None)):
        rows = frame(spark, texts, ids=ids)
        for bits in (bloom_lm.BITS, 0):
            got = scores(rows, F.lit(False), bits=bits, per_entry=600)
            want = sorted(((i, *w) for i, w in zip(ids or range(len(texts)), plain_scores(texts, [False] * len(texts)))), key=lambda r: repr(r[:5]))
            assert len(got) == len(want)
            for g, w in zip(sorted(got, key=lambda r: (repr(r[0]), r[2:5], r[6])), sorted(want, key=lambda r: (repr(r[0]), r[2:5], r[6]))):
                assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    alone = bloom_lm.score_documents(frame(spark, ["a b"]), F.lit(True)).collect()
    assert alone[0].train_tokens == 0 and math.isfinite(alone[0].score)


# --- 9: chat -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    texts = ["\\### Assistant: </turn> ok", "<part>a<part>", "a\\", "<", "</turn", "#####", "", None, "x:\n", "</turn>\n\\n", "é😀<part"]
    roles = ["user", "user", "assistant", "assistant", "a:\nb:", "system", None]
    rows = [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in range(150) for t in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.formatted(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for f in out.collect():
        mine = [(r or "unknown", t or "") for c, _, r, t in rows if c == f.conv_id]
        loss = "".join(t for r, t in mine if r == "assistant")
        g = got[f.conv_id]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(f.formatted)
        spans = "".join(f.formatted[s.start : s.start + s.n] for s in f.loss_spans)
        assert re.sub(r"(?s)\\(.)", r"\1", spans) == loss
        merged = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert f.formatted.count(chat.TURN_END) == merged
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_running_sums(spark):
    rnd = random.Random(9)
    rows = [[rnd.randint(0, 9) for _ in range(n)] for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000)]
    df = spark.createDataFrame([(x,) for x in rows], "x array<long>")
    got = [r[0] for r in df.select(chat.running(F.col("x"))).collect()]
    assert got == [[0, *itertools.accumulate(x)][: len(x)] for x in rows]


def test_chat_of_a_long_conversation(spark):
    """A conversation of 100,000 turns, whose time is that of its turns and not of their square."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    start = time.time()
    f = chat.formatted(rows).first()
    assert time.time() - start < 120
    assert len(f.loss_spans) == n // 2 and [(s.start, s.n) for s in f.loss_spans] == [(s.start, s.n) for s in f.loss_bytes]
    assert all(f.formatted[s.start : s.start + s.n] == f"t{2 * k + 1}" for k, s in enumerate(f.loss_spans))


def test_chat_of_null_ids_and_repeated_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, 1, "assistant", "x"), (5, 1, "assistant", "x"), (5, None, "user", "first"), (6, 1, "assistant", "w " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert (got[None].n_turns, got[None].loss_chars) == (2, 1)
    assert (got[5].n_turns, got[5].loss_sha256) == (3, hashlib.sha256(b"xx").hexdigest())
    assert got[6].loss_chars == 60_000


# --- long texts and missing ids through all operators ---------------------------------------------


def test_long_texts(spark):
    """Texts beyond 20,000 words, with something to find at their very end."""
    words = [f"word{k % 9000}x{k}" for k in range(25_000)]
    near = list(words)
    near[12_000] = "changed"
    tail = " mail a@b.co token = abcdef123456"
    df = frame(spark, [" ".join(words) + tail, " ".join(near) + tail, None])
    pii_rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    found = {r.doc_id: r for r in secrets.scan_history(df, scratch_path(spark, "long")).collect()}
    stats = {r.id: r for r in quality.statistics(df).collect()}
    near_rows = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    for k, text in enumerate((" ".join(words) + tail, " ".join(near) + tail)):
        assert pii_rows[k].n_email == 1 and f"email:{text.index('a@b')}:" in pii_rows[k].spans
        assert found[k].n_assign == 1 and stats[k].n_words == 25_005 and near_rows[k].component_id == 0
    out = scratch_path(spark, "long")
    token_files.write_token_files(df, out, byte_bpe.vocabulary_path(token_files.VOCABULARY), parts=2)
    tok = hugging()
    want = {0: " ".join(words) + tail, 1: " ".join(near) + tail, 2: ""}
    for r in token_files.read_digests(token_files.read_token_files(spark, out)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*tok.encode(want[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in byte_bpe.encode_digests(df, byte_bpe.vocabulary_path()).collect():
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_missing_ids(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g", "other words here that differ much"]
    for ids in ([None] * 4, [3, None, None, None]):
        rows = neardup.near_duplicates(frame(spark, texts, ids=ids)).collect()
        group = [r for r in rows if r.n_shingles in (3, 4) and r.component_id == (3 if ids[0] else None)]
        assert len(rows) == 4 and len([r for r in group if r.n_shingles == 4]) == 2
        assert any(r.kept for r in group)


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, data, docs):
    import corpus_pipeline as p

    before = table(spark, data, "documents")
    columns, kept = before.columns, {}
    for name, stage in p.STAGES[:-1]:
        before = p.materialize(stage(spark, before, data), name)
        assert before.columns == columns
        kept[name] = before.collect()
    ids = lambda rows: collections.Counter(r.doc_id for r in rows)
    judged = quality.judge(table(spark, data, "documents"), table(spark, data, "labels")).filter("kept")
    assert ids(kept["quality_rules"]) == ids(judged.collect())
    rows = sorted((r.doc_id, r.text) for r in kept["quality_rules"])
    plain = plain_components([t for _, t in rows])
    assert sorted(ids(kept["near_dedup"])) == sorted(rows[k][0] for k, (_, c) in enumerate(plain) if c == k)
    for r in kept["secret_scan"]:
        spans = [tuple(map(int, s.split(":")[1:])) for s in secrets.secret_row(docs[r.doc_id])[4].split(",") if s]
        assert (r.text == docs[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert all(docs[r.doc_id][s:e] not in r.text for s, e in spans)
    copies = ids(kept["mix_sources"])
    assert max(copies.values()) <= 2 and set(copies) <= set(ids(kept["secret_scan"]))
    last = p.STAGES[-1][1](spark, before, data).collect()
    assert ids(last) == copies
    text = {r.doc_id: r.text for r in kept["mix_sources"]}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)


def test_pipeline_rows_that_share_an_id(spark, data):
    import corpus_pipeline as p

    good = " ".join(f"word{k} of prose" for k in range(40))
    near = good + " end"
    rows = frame(spark, [good, good, near, "bad", "other " + " ".join(f"thing{k} here" for k in range(40)), None], ids=[7, 7, 7, 7, None, None]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = p.materialize(p.quality_rules(spark, rows, data), "q")
    assert sorted(r.text[:5] for r in kept.collect()) == ["other", "word0", "word0", "word0"]
    left = p.near_dedup(spark, kept, data).collect()
    assert len(left) == 2 and {r.doc_id for r in left} == {7, None}


CLASHING = ["__hash", "__blob", "__u", "__key", "__salt", "__parts", "__n", "row", "id", "hash", "blob", "spans", "u", "copies", "key_id", "size", "kept", "copy"]


@pytest.mark.parametrize("texts", [[], ODD])
def test_pipeline_of_odd_tables(spark, data, texts):
    import corpus_pipeline as p

    df = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES:
        df = p.materialize(stage(spark, df, data), name)
    assert df.count() <= 2 * len(texts)


def test_pipeline_hands_on_columns_of_any_name(spark, data):
    import corpus_pipeline as p

    prose = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(12)]
    texts = [*prose, prose[0], 'a token = "abcdef123456" ' + prose[1][40:] + " more", None]
    df = frame(spark, texts, sources=["a", "b", None] * 5).select("doc_id", "text", "lang", "source", "n_chars")
    for c in CLASHING:
        df = df.withColumn(c, F.concat(F.lit(f"{c} "), "doc_id"))
    for name, stage in p.STAGES[:-1]:
        before = df
        df = p.materialize(stage(spark, df, data), name)
        assert df.columns == before.columns, name
        for r in df.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in CLASHING), name
    assert df.count() and p.STAGES[-1][1](spark, df, data).count() == df.count()


def test_pipeline_stages_of_rows_that_share_an_id(spark, data):
    """Secrets and shares go by each row's own text."""
    import corpus_pipeline as p

    rows = frame(spark, ['x token = "abcdef123456" y', "plain words", 'x token = "abcdef123456" y', None], ids=[7, 7, None, 7]).select("doc_id", "text", "lang", "source", "n_chars")
    got = sorted((r.doc_id or 0, r.text or "") for r in p.secret_scan(spark, rows, data).collect())
    hidden = secrets.without('x token = "abcdef123456" y', secrets.secret_row('x token = "abcdef123456" y')[4], "[SECRET]")
    assert got == sorted([(7, hidden), (7, "plain words"), (0, hidden), (7, "")]) and "abcdef" not in hidden
    many = frame(spark, [f"{'w ' * (k + 1)}" for k in range(20)], ids=[7] * 20).select("doc_id", "text", "lang", "source", "n_chars")
    taken = collections.Counter(r.text for r in p.mix_sources(spark, many, data).collect())
    words = {t: len(t.split()) * n for t, n in taken.items()}
    assert set(taken) <= {f"{'w ' * (k + 1)}" for k in range(20)} and max(taken.values()) <= 2 and sum(words.values()) > 250


def test_top_k_where_ids_repeat_more_than_k_times(spark):
    same, half = [2.0, 0.0], [0.25, 0.0]
    rows = [(100, same)] * 12 + [(101, same), (102, half), (1, same), (200, half)] + [(300, half)] * 30 + [(301, half), (400, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 3, 10):
        got = sorted(map(tuple, cover_tree.top_k(df.filter("vec_id % 100 = 0"), df, k).collect()))
        assert got == plain_top(rows, sorted({(i, tuple(v)) for i, v in rows if i % 100 == 0}), k)
    rnd = random.Random(8)
    for _ in range(200):
        ids = np.array([rnd.choice([1, 2, 2, 2, 3, 3, 4, 5]) for _ in range(rnd.randint(1, 30))])
        v = np.array([[float(rnd.randint(0, 1))] for _ in ids])
        part, k = cover_tree.Part(ids, v, 3), 3
        for q in range(1, 7):
            want = sorted((-x, i) for i, x in zip(ids.tolist(), v[:, 0].tolist()) if i != q)[:k]
            some = cover_tree.Search(np.array([q]), np.ones((1, 1)), part.few_id, part.few, k)
            some.compare(np.array([0]), np.arange(len(part.few)))
            found = [(-s, i) for s, i in zip(some.score[0].tolist(), some.id[0].tolist()) if np.isfinite(s)]
            assert found == want
