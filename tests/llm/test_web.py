import base64
import hashlib
import random

from pyspark.sql import functions as F

from claimforge.llm import linedup, urlfilter, warc

PAGES = "page_id long, url string, html string, host string, digest string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "d", 1) for r in rows], PAGES)


def test_archives_round_trip(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nü"
    rows = [(1, "https://a.org/", tricky), (2, "https://b.org/\r\nX: y", tricky), (3, None, None), (4, "https://c.org", ""), (5, "u", "short"), (6, "v", "short"), (None, "w", "short"), (7, "z", "only " * 20_000), (9, "a", tricky)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, rows).repartition(3), path, records_per_file=2)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert set(got) == {r[0] for r in rows} and all(r["digest_ok"] for r in got.values())
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {p: r["refers_to"] for p, r in got.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5, None: 5, 7: None, 9: 1}
    assert got[1]["payload"] == tricky and got[2]["record_type"] == "revisit" and got[2]["refers_to_url"] == "https://a.org/" and got[2]["payload"] is None
    assert got[2]["url"] == "https://b.org/%0A%0AX: y"


def test_short_payloads_stay_and_empty_tables(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "a", "x"), (2, "b", "x"), (2, "b", "x")]), str(tmp_path / "w"), min_bytes=2)
    assert [r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()] == ["response"] * 3
    warc.write_archives(pages(spark, []), str(tmp_path / "e"))
    assert warc.resolve_revisits(spark.createDataFrame([], "id long, url string, digest string, bytes long")).count() == 0


def judged(host, path):
    best = None
    for action, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def test_rules_and_equivalence_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["EXAMPLE.com", "www.example.com", "a.www.example.com", "x.net", "net", "blog.org", "ÄÖ.org", "notexample.com", "com"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/es/2', '/fr', '/fr/', '?a=/en/', '#/es/'])}{rng.choice(['', '#x', '?q'])}" for _ in range(120)] + [None, "", "no scheme", "://", "http://h?x://y/en/"]
    link = lambda u: rng.choice([f'<link rel="canonical" href="{u}">', f"<LINK href='{u}' REL=canonical >", f'<meta http-equiv="refresh" content="0; url={u}">']) if u and "://" in u and rng.random() < 0.5 else "<p>canonical refresh</p>"
    rows = [(i, u, link(rng.choice(urls))) for i, u in enumerate(urls)]
    extra = [(rng.choice(urls), rng.choice(urls)) for _ in range(10)]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, rows), spark.createDataFrame(extra, "a string, b string")).collect()}
    found = urlfilter.page_edges(pages(spark, rows)).collect()
    node = lambda u: None if not split(u)[0] else u.split("://", 1)[0].lower() + "://" + split(u)[0] + u.split("://", 1)[1][len(split(u)[0]) :].split("#")[0]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in [tuple(e) for e in found] + [(node(a), node(b)) for a, b in extra]:
        if a and b:
            parent[find(a)] = find(b)
    members = {}
    for n in list(parent):
        members.setdefault(find(n), []).append((judged(*split(n)) or (None,))[0])
    for i, u, _ in rows:
        rule = judged(*split(u))
        carried = members.get(find(node(u)), []) if node(u) else []
        verdict = rule[0] if rule else "block" if "block" in carried and "allow" not in carried else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (*split(u), rule and rule[1], verdict), u
    assert any(r["verdict"] == "block" and r["rule"] is None for r in got.values()) and urlfilter.judge(pages(spark, [])).count() == 0


def parsed_edges(url, html):
    """Links of a page by the standard library's parser and resolver."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    found = {"base": [], "links": []}

    class Tags(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "base" and a.get("href"):
                found["base"].append(a["href"])
            elif tag == "link" and (a.get("rel") or "").lower() == "canonical" and a.get("href"):
                found["links"].append(a["href"])
            elif tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh" and "url=" in (a.get("content") or "").lower():
                found["links"].append(a["content"][a["content"].lower().index("url=") + 4 :].strip(" '"))

    Tags(convert_charrefs=True).feed(html or "")
    base = urljoin(url, found["base"][0]) if found["base"] else url
    return [urljoin(base, t) for t in found["links"]]


TARGETS = [
    "/es/new", "//x.net/es/y", "//X.NET/fr/", "../x", "../../../fr/a", "./", "..", ".", "a/./b/../c?x=/../y", "?q=/es/", "#part", "new", "new/", "es/", "/", "/es/../fr/", "/login?next=http://x.net/es/z", "next?to=https://a.org/",
    "https://x.net/es/2", "HTTP://X.net/es/2#f", "mailto:a@x.net", "javascript:go()", "/en/a:b", "...", "a/..", "/a/.",
]


def test_relative_links_against_the_standard_library(spark):
    bases = ["http://x.net/old", "http://x.net", "https://x.net/es/deep/er/page?q=/a/b#c/d", "http://X.net/?a", "http://blog.org/a/b/", "https://www.example.com/en/1#/x", "http://net#f"]
    form = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical >", '<meta http-equiv="refresh" content="0; url={}">', "<meta content=\"5;URL='{}'\" http-equiv=refresh>", '<base href="/fr/base/x"><link rel=canonical href="{}">', '<base href="//net/es/"><meta http-equiv=refresh content="0; url={}">']
    rows = [(u, f.format(t)) for u in bases for t in TARGETS for f in form]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(-1, None, form[0].format("/es/")), (-2, "", form[0].format("/es/")), (-3, "x.net/es/", form[0].format("y")), (-4, "http://a.org/", None)]

    def node(u):
        return u.split("://", 1)[0].lower() + "://" + split(u)[0] + u.split("://", 1)[1][len(split(u)[0]) :].split("#")[0] if split(u)[0] else None

    want = sorted((node(u), node(t)) for _, u, h in rows if node(u) for t in parsed_edges(u, h) if node(t) and node(t) != node(u))
    assert sorted(tuple(e) for e in urlfilter.page_edges(pages(spark, rows)).collect()) == want


def test_blocks_are_carried_over_relative_links(spark):
    refresh = '<meta http-equiv=refresh content="0; url={}">'
    rows = [(1, "http://x.net/old", refresh.format("/es/new")), (2, "http://x.net/a/b", '<link rel=canonical href="../fr/x">'), (3, "https://blog.org/", refresh.format("//x.net/es/x")), (4, "http://x.net/free", refresh.format("/en/new")), (5, "http://x.net/old", None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "block")}


def test_lines_of_a_site(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        host = rng.choice(["hot.org"] * 6 + ["b.org", "small.org"] if i > 8 else ["tiny.org"])
        lines = [f"menu {host}", *(f"line {rng.randrange(40)}" for _ in range(4)), f"own {i}", *(["rare"] * 2 if i % 9 == 0 else [])]
        rows.append((i, f"https://{host}/{i}", "<script>x</script>" + "".join(f"<p> {x} </p>" for x in lines)))
    rows += [(900, None, None), (901, "https://hot.org/", ""), (902, None, "<p>a</p>")]
    got = {r["page_id"]: r for r in linedup.site_line_dedup(pages(spark, rows), max_ratio=0.3, min_pages=10).collect()}
    by_host = {}
    texts = {i: [x.split("</p>")[0].strip() for x in (h or "").split("<p>")[1:]] for i, _, h in rows}
    for i, u, _ in rows:
        by_host.setdefault(split(u)[0], []).append(i)
    for host, ids in by_host.items():
        for i in ids:
            kept = [x for x in texts[i] if len(ids) < 10 or sum(x in texts[j] for j in ids) / len(ids) <= 0.3]
            assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(texts[i]), len(texts[i]) - len(kept))
    assert "menu hot.org" not in got[50]["text"].split("\n") and linedup.site_line_dedup(pages(spark, [])).count() == 0


def test_lines_of_small_sites(spark):
    rows = []
    for size in (1, 2, 3, 4, 7, 9, 10):
        rows += [(100 * size + i, f"http://s{size}.org/{i}", "".join(f"<p>{x}</p>" for x in ("menu", f"own {i}", *(["two"] if i < 2 else []), *(["three"] if i < 3 else [])))) for i in range(size)]
    held = {}
    for i, u, h in rows:
        held.setdefault(split(u)[0], {})[i] = [x.split("</p>")[0] for x in h.split("<p>")[1:]]
    got = {r["page_id"]: r["text"] for r in linedup.site_line_dedup(pages(spark, rows)).collect()}
    for site in held.values():
        for i, lines in site.items():
            on = [sum(x in other for other in site.values()) for x in lines]
            assert got[i] == "\n".join(x for x, n in zip(lines, on, strict=True) if n < 2 or n / len(site) <= 0.3), i
    assert got[100] == "menu\nown 0\ntwo\nthree" and got[905] == "own 5" and got[1000] == "own 0\ntwo\nthree" and got[900] == "own 0\ntwo"


def test_lines_of_texts(spark, docs):
    out = linedup.site_line_dedup(docs, "doc_id", F.col("source"), linedup.text_lines(F.col("text")), min_pages=5)
    assert out.count() == docs.count() and out.where("site = 'hot'").agg(F.sum("n_dropped")).first()[0] == 12
