import json

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridmill.llm import token_counts, url_filter

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", " ", "a", "hello world", "  x\n\n y\t", "<|endoftext|>a <|endoftext|>", "a" * 5000, "ab" * 3000, "naïve Ünïcode ñandú 東京 🙂🙂", "don't we'll I'M", "x\u00a0y\u2003z", "123 4567 $$$ !!"]


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    c = token_counts.counter(token_counts.TOKENIZER)
    for t in TEXTS:
        assert c.count(t) == expected(t), t[:40]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    assert token_counts.counter(token_counts.TOKENIZER).count(text) == expected(text)


def test_token_query_handles_nulls_and_extra_columns(spark):
    rows = [(1, None, 5), (None, "hello", 6), (2, "", 7), (2, "", 7), (3, "word " * 1025, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.token_counts(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (None, 5, 1, False), (2, 0, 0, False), (2, 0, 0, False), (3, 5125, expected("word " * 1025), True)], key=str)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def brute(url, rules=url_filter.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.EXAMPLE.com/en/x?y#z", "http://www.Example.com/en/", "http://wwwexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://x.net?/es/", "http://net/fr/#a", "http://a.www.example.com/en/q", "http://é.com/ü", "a://b://c/", "http://com:80/x"]
    df = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)] + [(None, urls[5], None, None)], "page_id long, url string, html string, host string")
    for r in url_filter.judge(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id] if r.page_id is not None else urls[5])
    assert url_filter.judge(df).count() == len(urls) + 1
    assert url_filter.judge(df.limit(0)).count() == 0
    # Another list in the same session.
    other = url_filter.judge(df, rules=[("block", "com/")]).where("rule is not null").collect()
    assert other and {(r.rule, r.verdict) for r in other} == {("com/", "block")}


def test_digest_survives_colliding_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "digest"
    path.write_bytes(url_filter.digest_bytes(url_filter.RULES))
    digest = url_filter.Digest(str(path))
    assert [digest.string(i).decode() if i >= 0 else None for i in digest.find([b"com/", b"net/fr/", b"org/"])] == ["com/", "net/fr/", None]
    path.write_bytes(url_filter.digest_bytes([]))
    assert url_filter.Digest(str(path)).find([b"x"]) == [-1]


def test_probes_of_very_long_urls(spark):
    host, path = "a." * 20_000 + "example.com", "/en/" + "x/" * 100_000
    assert len(url_filter.probes(host, path, [[1, 1], [2, 4], [3, 4]])) == 3
    rows = [(1, f"http://{host}{path}"), (2, "http://" + "." * 50_000 + "net/es/")]
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.com/en/", "block", len(host)), 2: ("net/es/", "block", 50_003)}


def test_byte_symbols_match_the_vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    assert set(token_counts.byte_symbols().values()) <= set(vocab)
