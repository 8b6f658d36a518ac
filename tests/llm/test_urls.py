import re
from collections import Counter, defaultdict

import pytest

from rulemesh.llm import urls as U

RULES = dict(U.RULES)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = [
        r for r in RULES
        if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])
    ]
    return max(fits, key=len, default=None)


def plain_segments(path):
    out = []
    for s in path.split("/"):
        if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", s):
            s = "{date}"
        elif re.fullmatch(r"\d+(\.[A-Za-z]\w{0,4})?", s):
            s = re.sub(r"^\d+", "{n}", s)
        elif re.fullmatch(r"(?=.*\d)[0-9a-fA-F\-]{8,}(\.[A-Za-z]\w{0,4})?", s):
            s = re.sub(r"^[0-9a-fA-F\-]+", "{x}", s)
        if s:
            out.append(s)
    return tuple(out)


def chi(own, whole):
    n, m, out = sum(own), sum(whole), 0.0
    if n == 0 or m == n:
        return 0.0
    for a, w in zip(own, whole):
        for seen, size in ((a, n), (w - a, m - n)):
            e = size * w / m
            out += (seen - e) ** 2 / e if e > 0 else 0
    return out


def plain_templates(rows):
    """rows: (host, segments, bad or None); template and purity of each."""
    at, rows_, rows = [""] * len(rows), rows, list(rows)
    for level in range(max((len(s) for _, s, _ in rows), default=0)):
        if level >= U.SHALLOW:  # where too few labels are left, tails end
            left = Counter()
            for k, (host, s, bad) in enumerate(rows):
                left[host, at[k]] += len(s) > level and bad is not None
            for k, (host, s, bad) in enumerate(rows):
                if len(s) > level and left[host, at[k]] < U.LEAST:
                    rows[k] = host, s[:level], bad
                    at[k] += "/" + U.REST
        children = defaultdict(lambda: [0] * 6)
        for k, (host, s, bad) in enumerate(rows):
            if len(s) > level:
                c = children[host, at[k], s[level]]
                after = s[level + 1] if len(s) > level + 1 else None
                c[0] += 1
                c[1] += bad is not None
                c[2] += bad or 0
                c[3 if after is None else 4 if after.startswith("{") else 5] += 1
        fan, whole = Counter(), defaultdict(lambda: [0] * 6)
        for (host, t, _), c in children.items():
            fan[host, t] += 1
            whole[host, t] = [a + b for a, b in zip(whole[host, t], c)]
        for k, (host, s, _) in enumerate(rows):
            if len(s) > level:
                c, w, f = children[host, at[k], s[level]], whole[host, at[k]], fan[host, at[k]]
                name = s[level]
                if not name.startswith("{"):
                    same = f > 1 and chi(c[3:], w[3:]) <= U.SHARES_3 and chi([c[2], c[1] - c[2]], [w[2], w[1] - w[2]]) <= U.SHARES_2
                    name = U.WILD if f > U.FAN and c[0] < U.RARE * w[0] else U.MERGED if same else name
                at[k] += "/" + name
    rows = rows_
    total, by_host, by_template = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, _, bad), t in zip(rows, at):
        for x in (total, by_host[host], by_template[host, t]):
            x[0] += bad is not None
            x[1] += bad or 0
    share = total[1] / total[0] if total[0] else 0.0
    out = []
    for (host, *_), t in zip(rows, at):
        h, x = by_host[host], by_template[host, t]
        p = (h[1] + U.WEIGHT * share) / (h[0] + U.WEIGHT)
        p = (x[1] + p * U.WEIGHT) / (x[0] + U.WEIGHT)
        out.append((t, p, p >= U.PURITY and x[0] >= U.LEAST))
    return out


def check(found, pages, bad):
    parts = [plain_parts(u) for _, u in pages]
    want = plain_templates([(h, plain_segments(p), bad.get(i)) for (i, _), (h, p) in zip(pages, parts)])
    expected = Counter()
    for (i, _), (h, p), (t, purity, rejected) in zip(pages, parts, want):
        r = plain_rule(h, p)
        expected[i, h, p, r, RULES[r] if r else "block" if rejected else "allow", t, round(purity, 9)] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in found) == expected


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bad = {}
    for i, u in pages:
        m = re.search(r"/(\d+)(\.\w+)?/?$", plain_parts(u)[1])
        if m and int(m[1]) in quality:
            bad[i] = int(quality[int(m[1])] == 0)
    check(U.op1_path_template_tree(spark, sf_dir).collect(), pages, bad)


@pytest.fixture(scope="module")
def site():
    """One host with slugs, a bad section and good ones that look alike."""
    pages, bad = [], {}
    for k in range(400):
        section = ("news", "sport", "casino", "wiki")[k % 4]
        tail = f"article-{chr(97 + k % 26)}{chr(97 + k // 26)}z" if section == "wiki" else f"{k}/2024-05-0{k % 9 + 1}" if section == "sport" else str(k)
        pages.append((k, f"http://site.org/{section}/{tail}"))
        if k % 3 == 0:
            bad[k] = int(section == "casino")
    return pages, bad


def test_bad_section_is_blocked_and_similar_ones_merge(spark, site):
    pages, bad = site
    labelled = spark.createDataFrame(list(bad.items()), "id long, bad int")
    found = U.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled).collect()
    check(found, pages, bad)
    assert {r.verdict for r in found if "/casino/" in r.path} == {"block"}
    assert {r.verdict for r in found if "/casino/" not in r.path} == {"allow"}
    assert {r.template for r in found if r.path.startswith("/wiki/")} == {"/wiki/{*}"}


def test_sections_far_down_a_path_are_told_apart(spark):
    pages, bad = [], {}
    deep = "/".join("abcdefgh")
    for k in range(200):
        pages.append((k, f"http://deep.org/{deep}/{'bad' if k % 2 else 'good'}/{'x/' * 40}{k}"))
        if k % 3:
            bad[k] = k % 2
    pages += [(1000 + k, f"http://deep.org/{deep}/other/{k}/tail-{chr(97 + k)}") for k in range(9)]
    labelled = spark.createDataFrame(list(bad.items()), "id long, bad int")
    found = U.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled).collect()
    check(found, pages, bad)
    assert {r.verdict for r in found if "/bad/" in r.path} == {"block"}
    assert {r.verdict for r in found if "/bad/" not in r.path} == {"allow"}
    assert {r.template for r in found if "/other/" in r.path} == {f"/{deep}/other/{{**}}"}


ODD = [
    (1, None), (2, ""), (3, "no scheme/net/"), (4, "://"), (5, "HTTP://A.NET"), (6, "x://a.net?q"), (7, "x://a.net/#f"),
    (8, "x://B.Example.COM/de/1"), (9, "x://example.com/de"), (10, "x://notexample.com/de/1"), (11, "x://a://b/c"),
    (12, "x://example.net/en/" + "s/" * 5000), (13, "x://h/2020-01-02/deadbeef99/7.html"), (None, "x://org/fr/"), (14, "x://É.ORG/fr/é"),
    (14, "x://É.ORG/fr/é"), (15, "x://h?://n/"),
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, 1.0, "h") for i, u in ODD], "page_id long, url string, purity double, host string")
    labelled = spark.createDataFrame([(1, 1), (5, None), (None, 1), (99, 1), (8, 0), (8, 1)], "id long, bad int")
    check(U.filter_urls(pages, labelled).collect(), ODD, {1: 1, 8: 1})
    assert U.filter_urls(pages.limit(0), labelled).count() == 0
    check(U.filter_urls(pages, labelled.limit(0)).collect(), ODD, {})
