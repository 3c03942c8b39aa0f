import itertools

from echofold.llm import chat, urlrules

URLS = [
    "http://www.Example.com/en/1?x#y", "https://a.example.com/en/", "https://example.com/en", "https://example.com/fr/", "http://x.net/es/1",
    "http://net/fr/", "http://x.net/de/", "http://notexample.com/en/", "http://com", "http://com/", "http://b.org/casino/1", "http://spam-farm.org",
    "http://spamfarm.org", None, "", "no scheme", "a://b://c.com/d", "http://h.com?x=/en/", "http://Ünï.com/É", "http://x.net/es",
    "javascript:void", "http://example.com/en/casino", "http://u\n.com/x",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(URLS)], "page_id long, url string, Verdict string")
    got = {inline: sorted(map(tuple, urlrules.judge(df, urlrules.SITES + urlrules.METHOD, inline=inline).collect())) for inline in (True, False)}
    assert got[True] == got[False]
    for k, url, host, path, rule, verdict, method in got[True]:
        want = brute(URLS[k])
        assert (host, path, rule) == want[:3] and url == URLS[k]
        assert verdict == (want[3] or ("block" if any(w in (host + path) for w in ("casino", "spam-")) else "allow")), url
        assert (method is None) or rule is None
    assert urlrules.judge(df.limit(0), urlrules.SITES).collect() == []


def test_method_rules(spark):
    cases = {
        "http://b.org/login": "/login/", "http://b.org/a/wp-login.php": "/wp-login.php/", "http://b.org/loginpage": None, "http://b.org/x/photo.jpg": ".jpg", "http://b.org/x.jpg/y": None,
        "http://10.0.0.1/x": "numeric host", "http://b.org/calendar/2024/1/31": "calendar day", "http://b.org/a;jsessionid=1": "session id", "http://b.org/casino/x.exe": "casino", "http://www.b.com/login": None,
        "http://b.org/text.html": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    for inline in (True, False):
        got = {r.url: r.method_rule for r in urlrules.judge(df, urlrules.SITES + urlrules.METHOD, inline=inline).collect()}
        assert got == cases


def test_rules_as_a_table(spark):
    """Far more rules than travel in a plan; one token in a third of all URLs; no rule without its URLs."""
    rules = spark.range(3000).selectExpr("concat('hot ', id) as name", "if(id % 2 = 0, 'block', 'allow') as action", "concat('/hot/n', id, '(/|\\\\z)') as pattern", "array('hot', concat('n', id)) as tokens", "0 as rank")
    urls = spark.range(900).selectExpr("id as page_id", "if(id % 3 = 0, concat('http://b.org/hot/n', id), concat('http://b.org/', id)) as url")
    got = urlrules.judge_table(urls, rules).collect()
    assert len(got) == 900
    for r in got:
        hot = r.page_id % 3 == 0
        assert r.method_rule == (f"hot {r.page_id}" if hot else None) and r.verdict == ("block" if hot and r.page_id % 2 == 0 else "allow")


def test_rarest_token():
    rules = urlrules.SITES
    by = urlrules.index(rules, {"com": 9, "example": 5, "en": 7, "www": 1, "net": 3, "es": 4, "fr": 2})
    assert {k: [r.name for r in v] for k, v in by.items()} == {"com": ["com/"], "example": ["example.com/en/"], "www": ["www.example.com/en/"], "net": ["net/es/"], "fr": ["net/fr/"]}


TURNS = [
    (0, 0, "user", "Hi"), (0, 1, "assistant", "A"), (0, 2, "user", "q"), (0, 3, "assistant", "é𝄞"),
    (1, 0, "user", "Hi"), (1, 1, "assistant", "A"), (1, 2, "user", "other"), (1, 3, "assistant", "z"),
    (2, 0, "user", "same"), (2, 1, "assistant", "s"), (2, 1, "assistant", "s"), (3, 0, "user", "same"), (3, 1, "assistant", "s"),
    (4, 0, "user", "alone"), (7, 0, None, None), (None, 0, "user", "lost"), (8, None, "system", "n"), (8, 1, "user", "b"), (8, 1, "user", "a"), (9, 0, "user", "x" * 100000),
]


def brute_pairs(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, {}).setdefault(-1 if t is None else t, []).append((r or "unknown", x or ""))
    out = []
    for p in {None if c is None else c // 2 for c in convs}:
        a, b = (None, None) if p is None else (2 * p, 2 * p + 1)
        left, right = convs.get(a, {}), convs.get(b, {}) if p is not None else {}
        pos = sorted({*left, *right})
        differ = next((t for t in pos if sorted(left.get(t, [])) != sorted(right.get(t, []))), 10**9)
        turns = lambda side, test: [x for t in sorted(side) if test(t) for x in sorted(side[t])]
        row = [p, 0, a if a in convs and p is not None else None, b if b in convs and p is not None else None]
        prompt = turns(left, lambda t: t < differ)
        row += [len(prompt), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in prompt)]
        for side in (left, right):
            text, marks = "", []
            for r, x in turns(side, lambda t: t >= differ):
                text += f"<|im_start|>{r}\n"
                if r == "assistant":
                    marks.append(f"{len(text)}:{len(text) + len(x) + 11}")
                text += f"{x}<|im_end|>\n"
            row += [text, ",".join(marks)]
        out.append(tuple(row))
    return out


def test_preferences(spark):
    df = spark.createDataFrame([(*r, 1) for r in TURNS], "conv_id long, turn long, role string, text string, part int")
    got = [tuple(r) for r in chat.preferences(chat.by_parity(df)).collect()]
    assert sorted(got, key=str) == sorted(brute_pairs(TURNS), key=str)
    assert chat.preferences(chat.by_parity(df.limit(0))).collect() == []


def test_parts_join_up(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{min(t, 5 + c)}") for c, t in itertools.product((0, 1), range(20))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.preferences(chat.by_parity(df)).collect()[0]
    parts = sorted(chat.preferences(chat.by_parity(df), part_turns=3).collect(), key=lambda r: r.part)
    for c in ("prompt", "chosen", "rejected"):
        assert "".join(r[c] for r in parts) == whole[c]
    assert whole.n_prompt_turns == 6 == sum(r.n_prompt_turns for r in parts)
