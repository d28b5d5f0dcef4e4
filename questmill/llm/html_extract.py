"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

The trees judge for each node whether it holds main text, from its own tag and
attribute words, those of its ancestors, the density of its subtree, depth and
siblings. Decoding picks the set of nodes with the highest total log-odds in which
every node's parent is picked too, so no line is kept inside a part that is
dropped, and a part is kept only if what it holds is worth it. There are no
labelled pages, so the trees are fitted, in Spark, on pages made up from many
layouts whose main text is known; their number and seed are parameters.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.llm.common import in_slices, session_dir, written
from questmill.llm.html_nodes import INLINE, Node, features, parse, shown, text_of

#: Made-up pages to fit on, trees, and their depth.
PAGES, TREES, DEPTH = 1800, 40, 5
#: A private character that the pages themselves never hold.
_MARK = "\ue000"


class _Maker:
    """Pages of random layouts; words of the main text carry a mark."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int, mark: str = "") -> str:
        r = self.r
        out = []
        for k in range(r.randint(least, most)):
            w = "".join(r.choice(["th", "er", "an", "in", "on", "le", "que", "ei", "st", "ra", "o", "a"]) for _ in range(r.randint(1, 4)))
            w = w.capitalize() if k == 0 or r.random() < 0.05 else w
            out.append(mark + w + (r.choice(",.;:|") if r.random() < 0.12 else ""))
        return " ".join(out) + (r.choice(".?!") if r.random() < 0.8 else "")

    def box(self, inner: str, tags: str, names: str, always: float = 0.85) -> str:
        r = self.r
        tag = r.choice(tags.split())
        name = r.choice(names.split()) if names and (r.random() < always or tag in ("div", "section", "ul")) else ""
        if name and r.random() < 0.3:
            name += r.choice([" clearfix", " wrap", "-1", " col-4", "_box", " js-x"])
        quote = r.choice(['"', '"', "'"])
        attr = f" {r.choice(['class', 'class', 'id'])}={quote}{name}{quote}" if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, least: int, most: int) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(least, most))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if style < 0.8 else " ").join(items) if style < 0.9 else "".join(f"<div>{i}</div>" for i in items)

    def paragraph(self, mark: str) -> str:
        r = self.r
        text = self.words(1, 8, mark) if r.random() < 0.25 else " ".join(self.words(4, 16, mark) for _ in range(r.randint(1, 6)))
        if r.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 4, mark)}</a> {self.words(2, 8, mark)}'
        if r.random() < 0.1:
            text = f"<b>{text}</b>" if r.random() < 0.5 else f"<em>{self.words(1, 3, mark)}</em> {text}"
        shape = r.random()
        if shape < 0.12:
            return f"<p><b>{text}<br>"
        return f"<p>{text}" if shape < 0.2 else f"<div>{text}</div>" if shape < 0.25 else f"<p>{text}</p>"

    def article(self) -> str:
        r, m = self.r, _MARK
        out = [f"<h1>{self.words(2, 10, m)}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice([0, 0, 1, 1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.78:
                out.append(self.paragraph(m))
            elif kind < 0.85:
                out.append(f"<h{r.choice('234')}>{self.words(1, 6, m)}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 14, m)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.925:  # links with what is said of each
                out.append("<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 4, m)}</a> {self.words(2, 14, m)}</li>' for i in range(r.randint(2, 8))) + "</ul>")
            elif kind < 0.945:
                out.append(f"<blockquote><p>{self.words(5, 30, m)}</p></blockquote>")
            elif kind < 0.96:
                cells = lambda: "".join(f"<td>{self.words(1, 4, m)}</td>" for _ in range(3))
                out.append("<table>" + "".join(f"<tr>{cells()}</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.98:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 10, m)}</figcaption></figure>")
            else:
                out.append(f"<pre><code>{self.words(4, 20, m)}</code></pre>")
        if r.random() < 0.35:  # what stands inside an article without being its text
            out.insert(r.randint(0, len(out)), self.noise())
        return "".join(out) or f"<p>{self.words(1, 6, m)}</p>"

    def noise(self) -> str:
        r = self.r
        text = lambda: " ".join(self.words(3, 14) for _ in range(r.randint(1, 4)))
        kind = r.randrange(7)
        if kind == 0:
            return self.box(r.choice([text(), f"<p>{text()}</p>", f'<a href="/b">{self.words(2, 6)}</a>']), "div div aside section", "ad ads advert advertisement ad-slot banner-ad sponsored promo adsense sponsor")
        if kind == 1:
            return self.box(f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 6), "aside div section", "related related-posts more-stories recommended popular trending widget")
        if kind == 2:
            return self.box(self.links(2, 6), "div ul div", "share social social-links sharing tags meta follow")
        if kind == 3:
            return self.box(f"<p>{text()}</p><form><input type=text><button>{self.words(1, 2)}</button></form>", "div section form", "newsletter subscribe signup search login-form contact-form")
        if kind == 4:
            return self.box(f"<p>{text()}</p><button>{self.words(1, 2)}</button>", "div section dialog", "cookie cookie-notice consent gdpr-banner notice popup modal alert disclaimer privacy-notice")
        if kind == 5:
            return f"<form>{self.words(1, 4)}<label>{self.words(1, 3)}</label><input><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button></form>"
        return self.box(self.links(1, 6), "nav div", "breadcrumb breadcrumbs pagination pager toc toolbar")

    def talk(self) -> str:
        r = self.r
        one = lambda: self.box(f"<p>{' '.join(self.words(3, 14) for _ in range(r.randint(1, 5)))}</p>", "div li article", "comment reply comment-body comment-item response review")
        inner = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 7)))
        return self.box(inner, "section div ol ul", "comments comment-list discussion responses disqus-thread replies commentlist reader-comments", 1.0)

    def page(self) -> str:
        r = self.r
        head = f"<head><meta charset=utf-8><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        edge = lambda names, tags: self.box(r.choice([f"<p>{self.words(2, 12)}</p>", self.words(2, 14), f"&copy; {self.words(1, 2)} &middot; {self.words(3, 14)}", self.links(2, 6), f"<h2>{self.words(1, 4)}</h2>" + self.links(1, 5)]), tags, names)
        before, after = [], []
        if r.random() < 0.6:
            before.append(edge("header site-header masthead top topbar page-header", "header header div"))
        if r.random() < 0.8:
            before.append(self.box(self.links(3, 9), "nav nav div ul", "nav menu navbar main-menu navigation main-nav"))
        for side in (before, after):
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                side.append(self.noise())
        if r.random() < 0.4:
            box = self.box(f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(2, 8), f"<p>{' '.join(self.words(3, 14) for _ in range(3))}</p>"]), "aside aside div", "sidebar side rail widget-area sidebar-right")
            (before if r.random() < 0.4 else after).append(box)
        if r.random() < 0.4:
            after.insert(0, self.talk())
        if r.random() < 0.75:
            after.append(edge("footer site-footer bottom copyright legal page-footer credits", "footer footer div"))
        text = self.article()
        if r.random() < 0.15 and "comment" not in text:
            text += self.talk()
        shape = r.random()
        if shape < 0.3:  # no box, or one without a name
            tag = r.choice("section div div main article".split())
            core = text if shape < 0.18 else f"<{tag}>{text}</{tag}>"
        else:
            core = self.core(text)
        if r.random() < 0.12:
            before, after = [], []
        elif r.random() < 0.1:
            before = []
        body = "".join(before) + core + "".join(after)
        if r.random() < 0.3:
            body = self.box(body, "div div section", "page wrapper container site app layout root", 0.7)
        end = "" if r.random() < 0.2 else "</body></html>"
        return f"<!DOCTYPE html><html lang=en>{head}<body>{body}{end}"

    def core(self, text: str) -> str:
        r = self.r
        core = self.box(text, "article article main div div section", "article post content entry-content main-content story post-body article-body text prose page-content blog-post", 0.55)
        if r.random() < 0.3:
            core = self.box(core, "main div section", "main content container wrapper page primary", 0.6)
        return core


def made_page(seed: int) -> tuple[str, str]:
    """A made-up page and its main text."""
    marked = _Maker(seed).page()
    nodes = parse(marked)
    for node in nodes:
        node.parts = [p if not isinstance(p, str) or _MARK in p or not p.strip() else "" for p in node.parts]
    return marked.replace(_MARK, ""), text_of(nodes, shown(nodes)).replace(_MARK, "")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seed in batch.column(0).to_pylist():
            nodes = parse(_Maker(seed).page())
            good = np.zeros(len(nodes))
            for i in range(len(nodes) - 1, -1, -1):
                good[i] = max(good[i], any(isinstance(p, str) and _MARK in p for p in nodes[i].parts))
                if nodes[i].parent >= 0:
                    good[nodes[i].parent] = max(good[i], good[nodes[i].parent])
                nodes[i].parts = [p.replace(_MARK, "") if isinstance(p, str) else p for p in nodes[i].parts]
            asked = _asked(nodes)
            x = features(nodes)[asked]
            if len(x):
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(good[asked])], names=["x", "label"])


def _asked(nodes: list[Node]) -> np.ndarray:
    """The nodes that the trees judge: shown ones below the body, and of inline ones only those that stand between blocks."""
    live = shown(nodes)
    blocks = np.zeros(len(nodes), bool)
    for node in nodes:
        if node.parent >= 0 and node.tag not in INLINE:
            blocks[node.parent] = True
    return np.array(
        [i for i, n in enumerate(nodes) if live[i] and n.tag not in ("#root", "html", "body") and (n.tag not in INLINE or blocks[n.parent])], np.int64
    )


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as arrays; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += weight * self.value[at]
        return 2 * out


def _read(model: object, depth: int) -> Trees:
    """The trees of a fitted model, from their description."""
    rows: list[list[float]] = []
    roots = []
    for tree in model.trees:  # type: ignore[attr-defined]
        lines = [s.strip() for s in tree.toDebugString.split("\n")[1:] if s.strip()]

        def node(lines: list[str]) -> int:
            at = len(rows)
            rows.append([0, np.inf, at, at, 0.0])
            line = lines.pop(0)
            if m := re.match(r"Predict: (\S+)", line):
                rows[at][4] = float(m[1])
                return at
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            rows[at][:2] = [int(m[1]), float(m[2])]
            rows[at][2] = node(lines)
            lines.pop(0)  # Else
            rows[at][3] = node(lines)
            return at

        roots.append(node(lines))
    a = np.array(rows)
    whole = lambda c: a[:, c].astype(np.int64)
    return Trees(whole(0), a[:, 1], whole(2), whole(3), a[:, 4], np.array(roots), np.array(model.treeWeights), depth)  # type: ignore[attr-defined]


def fit(spark: SparkSession, pages: int = PAGES, seed: int = 1, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees fitted on made-up pages, once a session for the same parameters: the model is kept in the shared folder."""
    path = f"{session_dir(spark)}/trees-{pages}-{seed}-{trees}-{depth}"
    try:
        return _read(GBTClassificationModel.load(path), depth)
    except (AnalysisException, Py4JJavaError):  # not fitted yet
        pass
    seeds = spark.range(seed * 1_000_000, seed * 1_000_000 + pages, 1, 8)
    rows = written(seeds.mapInArrow(_examples, "x array<double>, label double"), "nodes")
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7)
    fitted = model.fit(rows.select(array_to_vector("x").alias("v"), "label"))
    fitted.write().overwrite().save(path)
    return _read(fitted, depth)


def decode(nodes: list[Node], asked: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The nodes to keep: the set of highest total log-odds that holds the parent of each of its nodes."""
    live = shown(nodes)
    gain = np.zeros(len(nodes))
    gain[asked] = odds
    own = np.zeros(len(nodes), bool)
    own[asked] = True
    for i in range(len(nodes) - 1, 0, -1):
        if live[i] and gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i, n in enumerate(nodes[1:], 1):
        keep[i] = keep[n.parent] and live[i] and (gain[i] > 0 or not own[i] and (n.tag in INLINE or gain[i] >= 0))
    return keep


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """pages with main_text (blocks in page order, one a line) and n_chars (its code points).

    A null or empty page has the empty text. Deeply nested and very long pages
    are read in time proportional to their length, and whole. Columns of pages
    with the names of the new ones are replaced; all others stay, repeated rows too.
    """
    held = pages.sparkSession.sparkContext.broadcast(trees)
    kept = pages.drop("main_text", "n_chars")
    names = kept.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 100):
            parsed = [parse(h) for h in batch.column(names.index(html_col)).to_pylist()]
            asked = [_asked(n) for n in parsed]
            x = [features(n)[a] for n, a in zip(parsed, asked, strict=True)]
            odds = np.split(held.value.log_odds(np.concatenate(x)), np.cumsum([len(a) for a in asked])[:-1]) if x else []
            texts = [text_of(n, decode(n, a, o)) for n, a, o in zip(parsed, asked, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "main_text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(rows, f"{fields}, main_text string, n_chars long")
