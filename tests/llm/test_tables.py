import hashlib

from prismark.llm import fingerprints, url_lists


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2000)  # several ranges
    texts = {i * 2: " ".join(f"w{(i * 7 + j) % 997}" for j in range(i * 9)) for i in range(40)} | {100: None, 101: "", 102: "é" * 33, 104: "same text here", 105: "same text here"}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, place int").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprint_table(docs).collect()}
    order = sorted(texts)
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if not a and not b:
            assert got[d].near_edited == 1.0 and got[d].fingerprint == ""
        if a == b:
            assert got[d].near_edited == 1.0
    assert got[104].fingerprint == got[105].fingerprint and got[104].near_next == 1.0
    assert got[100].near_next == 1.0  # null and empty
    long = [d for d in order if len(shingles(texts[d] or "")) > 150]
    assert max(abs(got[d].near_edited - len(shingles(texts[d]) & shingles(e)) / len(shingles(texts[d]) | shingles(e))) for d in long for e in [texts[d][: len(texts[d]) - len(texts[d]) // 2] + (texts[order[(order.index(d) + 1) % len(order)]] or "")[: len(texts[d]) // 2]]) < 0.3


def test_fingerprint_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_table(empty).count() == 0
    alone = fingerprints.fingerprint_table(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c da b c ").hexdigest()
    twice = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b"), (6, "c")], "doc_id long, text string")
    assert fingerprints.fingerprint_table(twice).count() == 4


def test_sketches_merge_and_contain(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(400)))], "a string, b string")
    both = fingerprints.with_sketch(fingerprints.with_sketch(rows, "a", "sa"), "b", "sb")
    r = both.select(fingerprints.containment(both.sb, both.sa).alias("inside"), fingerprints.likeness(both.sa, both.sb).alias("near"), (fingerprints.merged(both.sa, both.sb) == both.sa).alias("same")).first()
    assert r.inside == 1.0 and 0.05 < r.near < 0.15 and r.same


CASES = [("http://A.Example.com:80/x", "a.example.com"), ("https://u:p@b.org./", "b.org"), ("ftp://c/d?e", "c"), ("nothing", None), (None, None), ("", None)]


def test_hosts(spark):
    frame = spark.createDataFrame(CASES, "url string, want string")
    assert all(r.host == r.want for r in frame.withColumn("host", url_lists.host_of(frame.url)).collect())


def test_lists_as_of_fetch(spark):
    entries = [("bad", "Example.com", "add", 10), ("bad", "example.com", "add", 12), ("bad", "example.com", "remove", 20), ("bad", "example.com", "add", 30), ("ads", "a.example.com", "add", 15),
               ("ads", "b.org", "remove", 5), ("ads", "b.org", "add", 7), ("ads", "b.org", "remove", 7), (None, "b.org", "add", 1), ("bad", "com", "odd", 1)]
    frame = spark.createDataFrame(entries, "list string, domain string, action string, day int")
    valid = url_lists.intervals(frame, "day")
    assert sorted((r.list, r.domain, r.valid_from, r.valid_to) for r in valid.collect() if r.list == "bad") == [("bad", "example.com", 10, 20), ("bad", "example.com", 30, None)]
    captures = [(i, u, d) for i, (u, d) in enumerate([("http://a.example.com/", 9), ("http://a.example.com/", 10), ("http://a.example.com/", 16), ("http://a.example.com/", 20), ("http://x.example.com/", 31), ("http://example.com.evil/", 31), (None, 31), ("http://b.org/", 7), ("http://a.example.com/", None), ("http://a.example.com/", 16)])]
    found = url_lists.evaluate(spark.createDataFrame([(*c, "h") for c in captures], "page long, url string, day int, host string"), valid, "day")
    assert [r.lists for r in found.orderBy("page").collect()] == [[], ["bad"], ["ads", "bad"], ["ads"], ["bad"], [], [], [], [], ["ads", "bad"]]
    assert url_lists.evaluate(spark.createDataFrame(captures, "page long, url string, day int").limit(0), valid, "day").count() == 0
    none = url_lists.evaluate(spark.createDataFrame(captures, "page long, url string, day int"), valid.limit(0), "day")
    assert all(r.lists == [] for r in none.collect())


def test_hot_hosts_and_clashing_columns(spark):
    frame = spark.createDataFrame([("bad", f"h{i % 7}.net", "add", i % 5) for i in range(30)] + [("net", "net", "add", 3)], "list string, domain string, action string, day int")
    valid = url_lists.intervals(frame, "day")
    rows = [(i, f"http://h{i % 7 if i % 3 else 0}.net/" + "x" * (200_000 if i == 5 else 1), i % 9, ["own"], "c", "d") for i in range(4000)]
    captures = spark.createDataFrame(rows, "page long, url string, day int, lists array<string>, captures string, domain string").repartition(5)
    got = {r.page: (r.lists, r.captures, r.domain) for r in url_lists.evaluate(captures, valid, "day").collect()}
    since = {}
    for _, domain, _, day in frame.collect():
        since[domain] = min(day, since.get(domain, 99))
    for page, url, day, *_ in rows:
        host = url.split("/")[2]
        assert got[page] == (sorted([x for x, d in (("bad", host), ("net", "net")) if since.get(d, 99) <= day]), "c", "d")
