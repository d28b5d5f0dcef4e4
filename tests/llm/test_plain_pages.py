"""Pages without named containers, written by hand, apart from the made-up pages that the trees are fitted on."""

from questmill.llm import html_extract

LINE = "The river rose slowly through the night and the people of the town watched it from their windows."
P, HEAD = f"<p>{LINE} {LINE}</p>", "<h1>A flood in spring</h1>"
TEXT, TITLE = f"{LINE} {LINE}", "A flood in spring"
ITEMS = "".join(f'<li><a href="/{i}">Thing {i}</a> is what we saw by the river in spring</li>' for i in range(6))
SHAPES = {
    "one paragraph": (f"<html><body>{P}</body></html>", TEXT),
    "two paragraphs": (f"<html><body>{P}{P}</body></html>", f"{TEXT}\n{TEXT}"),
    "three paragraphs": (f"<html><body>{P}{P}{P}</body></html>", "\n".join([TEXT] * 3)),
    "short paragraph": ("<html><body><p>A short note of one line stands here alone.</p></body></html>", "A short note of one line stands here alone."),
    "many paragraphs": (f"<html><body>{P * 300}</body></html>", "\n".join([TEXT] * 300)),
    "section": (f"<html><body><section>{P}{P}</section></body></html>", f"{TEXT}\n{TEXT}"),
    "div": (f"<html><body><div>{P}{P}</div></body></html>", f"{TEXT}\n{TEXT}"),
    "main": (f"<body><main>{HEAD}{P}</main></body>", f"{TITLE}\n{TEXT}"),
    "article": (f"<body><article>{P}{P}</article></body>", f"{TEXT}\n{TEXT}"),
    "heading": (f"<html><body>{HEAD}{P}{P}</body></html>", f"{TITLE}\n{TEXT}\n{TEXT}"),
    "no body": (P + P, f"{TEXT}\n{TEXT}"),
    "plain text": ("plain words only", "plain words only"),
    "list of links": (f"<body><article>{HEAD}<ul>{ITEMS}</ul></article></body>", TITLE + "".join(f"\nThing {i} is what we saw by the river in spring" for i in range(6))),
    "menu and footer": (f"<body><nav><a href=/>Home</a> <a href=/x>News</a></nav>{P}{P}<footer>Copyright the site</footer></body>", f"{TEXT}\n{TEXT}"),
    "named menu, unnamed section": (
        f"<body><ul class=menu><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul><section>{P}{P}</section><div class=footer><p>All rights reserved</p></div></body>",
        f"{TEXT}\n{TEXT}",
    ),
    "comments": (f"<body>{P}{P}<div class=comments><h3>Comments</h3><div class=comment><p>Nice text, thank you all</p></div></div></body>", f"{TEXT}\n{TEXT}"),
}


def test_plain_pages(spark):
    trees = html_extract.fit(spark)
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(SHAPES.values())], "page_id long, html string")
    got = {r.page_id: r.main_text for r in html_extract.extract(frame, trees).collect()}
    assert {name: got[i] for i, name in enumerate(SHAPES)} == {name: want for name, (_, want) in SHAPES.items()}
