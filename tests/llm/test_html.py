"""HTML extraction: the wrapper decides, tags settle the rest; joins, entities, depth, order of pages."""

import html
import json
import random

import pytest

from byteloom.llm import html_extract as H

RNG = random.Random(8)
WORDS = [a + b for a in "ba ce di fo gu la me ni po ru sa te vi wo".split() for b in "len rin tas mor vel dun ket sol par nis".split()]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def wrapper(pages):
    w = None
    for p in pages:
        root = H.parse(p)
        own = H.skeleton(root, H._title(root))
        w = own if w is None else H._merge(w, own)
    return w


def known(pages):
    t = json.loads(json.dumps(H.template(json.loads(json.dumps(wrapper(pages))))))
    return t | {"consts": frozenset(t["consts"])}


def plain(k, rng):
    """A page without article, main or telling class words: what stands where is only to be seen on many pages. Returns html and truth."""
    paras = [prose(rng.randint(20, 60), rng) for _ in range(rng.randint(1, 5))]
    title = prose(4, rng)
    links = "".join(f"<li><a href=/{k}/{j}>{prose(2, rng)}</a></li>" for j in range(6))
    side = f"<div class=kc><p>{prose(6, rng)}</p></div>"
    notice = "<p>Sign up and get our weekly digest for free.</p>"
    body = notice + "".join(f"<p>{p}</p>" for p in paras) + "<p>Written by the team, all opinions are our own.</p><p>Read our terms.</p>"
    page = f"<html><head><title>{title}</title></head><body><div class=ka><ul>{links}</ul></div><div class=kb><h1>{title}</h1>{body}</div>{side}<div class=kd>Imprint of the site</div></body></html>"
    return page, "\n".join([title, *paras])


def test_wrapper_decides_without_telling_tags():
    rng = random.Random(3)
    made = [plain(k, rng) for k in range(40)]
    t = known([p for p, _ in made])
    assert t["root"] == ["html", "body", "div.kb"] and t["sure"]
    right = sum(H.extract(p, t) == want for p, want in made)
    without = sum(H.extract(p, None) == want for p, want in made)
    assert right == 40 and without == 0


def test_wrapper_drops_template_parts_of_an_article():
    rng = random.Random(4)
    pages = []
    for k in range(12):
        extra = '<div class=x9>Follow the project on its site.</div>' if k % 2 else ""
        pages.append((f"<body><article><h1>T{k}</h1><p>Please read the rules first.</p><h2>Summary</h2><p>{(a := prose(9, rng))}</p>{extra}<p>{(b := prose(9, rng))}</p></article></body>", f"T{k}\nSummary\n{a}\n{b}"))
    t = known([p for p, _ in pages])
    assert [H.extract(p, t) for p, _ in pages] == [w for _, w in pages]
    assert sum(H.extract(p, t) != H.extract(p, None) for p, _ in pages) == 12


def test_copies_of_one_page_prove_nothing():
    page = "<body><article><h1>One</h1><p>All of it is text.</p></article></body>"
    assert H.extract(page, known([page] * 30)) == "One\nAll of it is text."


def test_few_pages_go_by_tags():
    rng = random.Random(5)
    pages = [f"<body><nav><p>{prose(90, rng)}</p></nav><article><p>Short {k}.</p></article><footer>{prose(90, rng)}</footer></body>" for k in range(2)]
    assert [H.extract(p, known(pages)) for p in pages] == ["Short 0.", "Short 1."]


def test_attributes_as_browsers_read_them():
    assert H.extract('<article><p>Hi <img alt="a<b c"> there</p><p title=\'x > y\'>and <a href="/?a=\'1>2\'">on</a></p></article>', None) == "Hi there\nand on"
    assert H.extract("<article><p>1 < 2 and 3 > 2 <math><mi>x</mi></math> <button>go</button></p></article>", None) == "1 < 2 and 3 > 2 x go"
    assert H.extract('<p>a<b class="x" "y">b</b></p>', None) == "ab"
    assert H.extract('<div role=main><div class=ad>no</div>yes</div></div>no more', None) == "yes"


@pytest.mark.parametrize("tag", ["div", "b", "ul", "table", "span hidden"])
def test_a_hundred_thousand_levels(tag):
    page = f"<p>top</p>{f'<{tag}>' * 100_000}deep" + f"</{tag.split()[0]}>" * 100_000 + "<p>after</p>"
    text = H.extract(page, None)
    assert text.startswith("top") and text.endswith("after") and ("deep" in text) == ("hidden" not in tag)
    w = json.loads(json.dumps(H._merge(H.skeleton(H.parse(page), 1), H.skeleton(H.parse("<p>x</p>" * 3), 2))))
    H.template(w)


def test_joins_and_entities_against_plain_code():
    rng = random.Random(6)
    for _ in range(60):
        blocks = [" ".join(rng.choice(["a", "&amp;", "é", "<", "“q”", "x&y", "中", ">"]) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 6))]
        page = "<article>" + "".join(f"\n <p>\t{html.escape(b).replace(' ', rng.choice(['  ', ' ', chr(10)]))} </p> <!-- <p>no</p> --><script>'</p>'</script>" for b in blocks) + "</article>"
        assert H.extract(page, None) == "\n".join(blocks)


def test_more_than_width_children_forget_nothing():
    rng = random.Random(7)
    names = ["q" + a + b for a in "abcdefghij" for b in "abcdefghijkl"]
    pages = ["<body><div class=zz>" + "".join(f"<div class={n}>{prose(5, rng)}</div>" for n in rng.sample(names, 30)) + f"</div><p>T{k}</p></body>" for k in range(60)]
    w = wrapper(pages)
    box = w[H.KIDS][0][H.KIDS][0]
    assert box[H.KEY] == "div.zz" and H.WIDTH < len(box[H.KIDS]) + 1 <= H.WIDTH + 2
    total = sum(len(n.text) for p in pages for n in every(H.parse(p)) if n.tag == "#")
    assert H._varying(w) == pytest.approx(total)


def every(root):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += n.kids


def test_hosts_whatever_the_order_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 3)
    rng = random.Random(9)
    made = {k: plain(k, rng) for k in range(60)}
    rows = [(k, f"http://h{k % 2}.example.com/{k}", p) for k, (p, _) in made.items()] + [(100, None, None), (101, "u", ""), (None, "http://h0.example.com/x", made[0][0]), (0, "http://h0.example.com/0", made[0][0])]
    for n, seed in ((1, 1), (13, 2)):
        random.Random(seed).shuffle(rows)
        got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()
        assert len(got) == len(rows)
        for r in got:
            want = made[0][1] if r["page_id"] is None else made[r["page_id"]][1] if r["page_id"] < 100 else ""
            assert r["text"] == want and r["n_chars"] == len(want)


def test_wrappers_that_do_not_fit_a_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    rng = random.Random(10)
    made = {k: plain(k, rng) for k in range(20)}
    got = H.main_text(spark.createDataFrame([(k, "http://h.example.com/", p) for k, (p, _) in made.items()], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: w for k, (_, w) in made.items()}
