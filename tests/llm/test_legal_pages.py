"""Pages that leave out end tags, as HTML allows, or forget them."""

import random

import pytest

from strandlake.llm.html_text import main_text


def sentence(rnd):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(12, 40))) + "."


def page(rnd, kind):
    """(html, lines of the article)"""
    lines = [sentence(rnd) for _ in range(rnd.randint(4, 12))]
    items = [sentence(rnd) for _ in range(rnd.randint(2, 4))]
    end_p, end_li = ("", "") if kind == "no end of p and li" else ("</p>", "</li>")
    head = "<head><title>A title</title><meta charset=utf-8><style>p { color: red }</style><noscript><link rel=stylesheet href=x></noscript>"
    head += {"no end of head": "", "no end of head, text": ""}.get(kind, "</head>")
    body = "" if kind == "no end of head, text" else "<body>"
    before = {
        "unclosed noscript": "<noscript>Enable scripts",
        "unclosed noscript in head": "",
        "unclosed button": "<button>Menu",
        "unclosed select": "<select><option>One<option>Two",
        "two buttons": "<button>One<button>Two</button>",
        "unclosed svg": "<svg><path d=x>",
        "unclosed video": "<video src=x>Your browser",
        "closed noscript": "<noscript><p>Turn scripts on to see this page in full, please do.</p><div>More of it, and more, and still more of it</div></noscript>",
        "misnested noscript": "<noscript><div>Turn scripts on to see this page in full, please do.</noscript>",
        "closed select": "<select><option>One</option><option>Two, which is a long choice of many words in one line</option></select>",
        "template": "<template><p>A hidden paragraph that nobody sees, however long it may be in the page.</p></template>",
    }.get(kind, "")
    if kind == "unclosed noscript in head":
        head = head.replace("</noscript>", "")
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a>{end_li}" for i in range(6)) + "</ul></nav>"
    inner = "".join(f"<p>{x}{end_p}" for x in lines) + "<ul>" + "".join(f"<li>{x}{end_li}" for x in items) + "</ul>"
    return f"<!doctype html><html>{head}{body}{menu}{before}<article><h1>The head line</h1>{inner}</article><footer><p>Copyright{end_p}</footer></html>", ["The head line", *lines, *items]


KINDS = ("plain", "no end of head", "no end of head, text", "no end of p and li", "unclosed noscript", "unclosed noscript in head", "unclosed button", "unclosed select", "two buttons", "unclosed svg", "unclosed video", "closed noscript", "misnested noscript", "closed select", "template")


@pytest.mark.parametrize("kind", KINDS)
def test_left_out_end_tags(kind):
    rnd = random.Random(kind)
    right = found = expected = 0
    for _ in range(60):
        html, lines = page(rnd, kind)
        got = main_text(html).split("\n")
        right += len(set(got) & set(lines))
        found, expected = found + len(got), expected + len(lines)
    assert 2 * right / (found + expected) > 0.97, (right, found, expected)


def test_silent_elements():
    assert main_text("<p>a b c</p><button>Press</button><p>d e f</p>") == "a b c\nd e f"
    assert main_text("<p>one <button>two</button> three</p>") == "one three"
    assert main_text("<p>one <noscript>two</noscript> three") == "one three"
    assert main_text("<head>Text that ends the head<p>more of it") == "Text that ends the head\nmore of it"
    assert main_text("<head><title>t</title><p>x") == "x"
    assert main_text("<script>var a = '<p>no</p>'") == "" == main_text("<noscript>only this")
    assert main_text("<table><tr><td><button>a<td>long text of a cell</table>") == "long text of a cell"
