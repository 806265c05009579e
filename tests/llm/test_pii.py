import hashlib
import random
import re

from quotemill.llm import pii


def brute(text):
    """The contract's patterns with Python's own engine."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        odd, even = d[-1::-2], d[-2::-2]
        if 16 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_plain_spans_equal_the_patterns():
    rnd = random.Random(8)
    bits = ["a", "B.c", "@", "mail@ex.com", "x%y+z-@a-b.c", ".", "..", "1", "23", "255", "256", "1.2.3.4", "-", " ", "+", "+1 (456) 555-2186", "4111 1111 1111 1111", "4387513035237269", "(", ")", "é", "\n", "007", "@a.b@c.d"]
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert pii.plain_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" + " " * 300_000, "a@" * 100_000, "one two " * 40_000):
        pii.spans(text)


def test_disguises_map_back():
    cases = {
        "write to jоhn.doе@exаmple.com now": [("email", "jоhn.doе@exаmple.com")],
        "mail jane [at] example [dot] org today": [("email", "jane [at] example [dot] org")],
        "mail jane.roe at example dot org today": [("email", "jane.roe at example dot org")],
        "mail jane(at)example.org": [("email", "jane(at)example.org")],
        "call plus one four five six five five five two one eight six ok": [("phone", "plus one four five six five five five two one eight six")],
        "host １９２.168.1.10 up": [("ip", "１９２.168.1.10")],
        "card 4111​111111111111 x": [("card", "4111​111111111111")],
        "we meet at noon and the dot was drawn": [],
        "one two three go": [],
        "they were at home. The dot is small at the end.": [],
        "plain +1 (456) 555-2186": [("phone", "+1 (456) 555-2186")],
    }
    for text, want in cases.items():
        plain, every = pii.spans(text)
        assert [(k, text[a:b]) for k, a, b in every] == want, text
        assert set(plain) <= set(every)


def test_disguises_that_shortcuts_left_out():
    cases = {
        "İ call plus one four five six five five five two one eight six ok": [("phone", "plus one four five six five five five two one eight six")],
        "host 10[punkt]0[point]0[punto]1 up": [("ip", "10[punkt]0[point]0[punto]1")],
        "mail ann at host\tdot\tcom today": [("email", "ann at host\tdot\tcom")],
        "mail ann at host punkt\ncom today": [("email", "ann at host punkt\ncom")],
        "mail x at example dot org today": [("email", "x at example dot org")],
    }
    for text, want in cases.items():
        assert [(k, text[a:b]) for k, a, b in pii.spans(text)[1]] == want, text
    assert [chr(i) for i in range(0x110000) if len(chr(i).lower()) != 1] == ["İ"]


def test_rows(spark):
    rows = [(1, "a@b.cc and a@b.cc"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "a@b.cc and a@b.cc")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.base_sha256, r.spans) for r in pii.find_pii(df).collect())
    two = "email:0:6,email:11:17"
    none = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, 2, 0, hashlib.sha256(two.encode()).hexdigest(), two)] * 2 + [(2, 0, 0, none, ""), (3, 0, 0, none, ""), (0, 0, 1, hashlib.sha256(b"ip:0:7").hexdigest(), "ip:0:7")])
    hidden = pii.mask_pii(df)
    assert hidden.columns == df.columns
    assert sorted(r.text or "" for r in hidden.collect()) == ["", "", "[email] and [email]", "[email] and [email]", "[ip]"]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_spans_that_reach_beyond_plain_ones_and_odd_letters():
    cases = {
        "mail john.dоe@example.com now": ("email:5:25", "mail [email] now"),
        "a​b@example.com": ("email:0:15", "[email]"),
        "jane at example\ndot\norg": ("email:0:23", "[email]"),
        "x at example\tdot\tcom": ("email:0:20", "[email]"),
        "call plus one four five six seven eight nine two İ": ("phone:5:48", "call [phone] İ"),
        "\U0001d423\U0001d428\U0001d41e@\U0001d41e\U0001d431.com": ("email:0:10", "[email]"),
    }
    for text, (span, masked) in cases.items():
        long = "word " * 5000
        for before in ("", long):
            kind, start, end = span.split(":")
            want = (kind, int(start) + len(before), int(end) + len(before))
            plain, every = pii.spans(before + text)
            assert want in every and set(plain) <= set(every)
            assert pii.masked(before + text) == before + masked


def test_rewritings_stand_by_themselves():
    cases = {
        "host 192 dot 168 dot 0 dot 1 up": [("ip", "192 dot 168 dot 0 dot 1")],
        "10 dot 0 dot 0 dot 1 [.]": [("ip", "10 dot 0 dot 0 dot 1")],
        "mail jane [at] example dot org": [("email", "jane [at] example dot org")],
        "mail jane at example [dot] org": [("email", "jane at example [dot] org")],
        "mail jane@example dot co dot uk now": [("email", "jane@example dot co dot uk")],
        "scrivi a anna at posta dot it.": [("email", "anna at posta dot it")],
    }
    for text, want in cases.items():
        assert [(k, text[a:b]) for k, a, b in pii.spans(text)[1]] == want, text


def test_clean_sentences_have_none():
    for text in (
        "see you at home dot dot dot", "he stood at noon dot it was late", "look at line dot dash and go on", "we met at five dot that is all", "they are at work dot I am not",
        "a dot and [another] dot at the end dot", "point at this point that we made", "version 1 dot 2 dot 3 is out", "see (at) the dot on the map",
    ):
        assert pii.spans(text)[1] == [], text


def test_many_spans_take_linear_time():
    text = " ".join(f"a{i}@b.com jane{i} [at] example [dot] org" for i in range(20_000))
    assert len(pii.spans(text)[1]) == 40_000
