"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Per path of a page the operator aggregates text
length and punctuation over its nodes, gives each node its path's ratios, smooths both sequences with a
Gaussian kernel over the order of the nodes, fuses them into one score and keeps the paths whose mean
score passes a threshold. All work on a page is local to its row, so the plan has no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, only

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open one of the same set.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | {x: {"p"} for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: A start tag doesn't close anything beyond these.
WALLS = frozenset("html body div article section main aside nav header footer table ul ol dl td th blockquote".split())
SKIPPED = frozenset("script style noscript template textarea title head iframe svg".split())
RAW = frozenset("script style textarea title".split())
#: All that may stand in a head; anything else ends one that is open.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript template noframes".split())
#: Of these one without an end tag ends where a block of the body starts.
LOOSE = frozenset("noscript template iframe svg".split())
BLOCKS = frozenset(CLOSES) | {"body"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡\"“”«»()]")


def _closed(page: str, name: str) -> set[int]:
    """Where those elements of a name begin that have an end tag of their own."""
    out: set[int] = set()
    opened: list[int] = []
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append(m.start())
        elif opened:
            out.add(opened.pop())
    return out


class _Stack:
    """The open elements. Every question about them takes constant time, but for what is closed by it.

    A path is the number of its last element, found by the number of its parent and its name.
    """

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[int] = []
        self.open: dict[str, int] = {}
        #: Since the last wall, with the wall itself: names and how often they are open.
        self.near: list[dict[str, int]] = [{}]
        self.skipped = 0
        self.heads: list[int] = []
        self.numbers: dict[tuple[int, str], int] = {}

    def push(self, name: str) -> None:
        above = self.paths[-1] if self.paths else -1
        if name == "head":
            self.heads.append(len(self.names))
        self.names.append(name)
        self.paths.append(self.numbers.setdefault((above, name), len(self.numbers)))
        self.open[name] = self.open.get(name, 0) + 1
        if name in WALLS:
            self.near.append({})
        self.near[-1][name] = self.near[-1].get(name, 0) + 1
        self.skipped += name in SKIPPED

    def pop(self) -> str:
        name = self.names.pop()
        self.paths.pop()
        self.open[name] -= 1
        if name == "head":
            self.heads.pop()
        if name in WALLS:
            self.near.pop()
        else:
            self.near[-1][name] -= 1
        self.skipped -= name in SKIPPED
        return name

    def cut(self, size: int) -> None:
        while len(self.names) > size:
            self.pop()

    def close(self, names: set[str]) -> None:
        """Ends the innermost open element of these names, if no wall stands above it."""
        if any(self.near[-1].get(x) for x in names):
            while self.pop() not in names:
                pass


def _nodes(page: str) -> tuple[list[int], list[str], dict[tuple[int, str], int]]:
    """(number of the path, text) of the visible text nodes in their order, and the numbers; -1 is the path above all tags."""
    stack = _Stack()
    paths: list[int] = []
    texts: list[str] = []
    loose: list[int] = []  # places in the stack of elements that lack an end tag
    closed: dict[str, set[int]] = {}
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        begin, at = at, m.end()
        name = m[2]
        if name is None:
            said = m[0]
            if said[0] == "<" and len(said) > 1:
                continue
            if stack.names and stack.names[-1] == "head" and not said.isspace():
                stack.pop()
            if stack.skipped:
                continue
            said = " ".join(html.unescape(said).split())
            if said:
                paths.append(stack.paths[-1] if stack.paths else -1)
                texts.append(said)
            continue
        name = name.lower()
        if m[1]:
            if stack.open.get(name):
                while stack.pop() != name:
                    pass
            continue
        while loose and loose[-1] >= len(stack.names):
            loose.pop()
        if name in BLOCKS and loose:
            stack.cut(loose[0])
            loose.clear()
        if stack.heads and (name == "body" or stack.names[-1] == "head" and name not in IN_HEAD):
            stack.cut(stack.heads[0])
        if ends := CLOSES.get(name):
            stack.close(ends)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in LOOSE:
            if name not in closed:
                closed[name] = _closed(page, name)
            if begin not in closed[name]:
                loose.append(len(stack.names))
        stack.push(name)
    return paths, texts, stack.numbers


def visible_text(page: str) -> str:
    """The visible text nodes, a line each."""
    return "\n".join(_nodes(page)[1])


def text_nodes(page: str) -> list[tuple[str, str]]:
    """(path, text) of the visible text nodes in their order; white space is folded, blank nodes are left out.

    Paths are spelled out, which takes their depth for each node; the operator works with their numbers.
    """
    paths, texts, numbers = _nodes(page)
    spelled = {-1: ""}
    for (above, name), number in numbers.items():
        spelled[number] = f"{spelled[above]}/{name}" if above >= 0 else name
    return [(spelled[p], t) for p, t in zip(paths, texts, strict=True)]


def _smooth(x: np.ndarray, radius: int) -> np.ndarray:
    """Gaussian smoothing that renormalises at the ends."""
    if radius < 1:
        return x
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius / 2, 0.5)) ** 2)
    return np.convolve(x, kernel)[radius:-radius] / np.convolve(np.ones(len(x)), kernel)[radius:-radius]


def extract(page: str, radius: int = 1, threshold: float = 0.5) -> tuple[str, int, int]:
    """(content, nodes kept, nodes in all).

    For a path with n nodes, c characters and m punctuation marks its ratios are c / n and m / n. After
    smoothing each sequence over the nodes, a node's score is the geometric mean of both, each divided
    by its mean over the page's characters; a path's score is the mean of its nodes'. Paths at or above
    threshold times the page's character-weighted mean score are content.
    """
    paths, texts, _ = _nodes(page)
    if not texts:
        return "", 0, 0
    path = np.unique(paths, return_inverse=True)[1]
    size = np.array([len(t) for t in texts], dtype=float)
    marks = np.array([len(MARKS.findall(t)) for t in texts], dtype=float)
    count = np.bincount(path)
    length_ratio = (np.bincount(path, size) / count)[path]
    mark_ratio = (np.bincount(path, marks) / count)[path]
    length_ratio, mark_ratio = _smooth(length_ratio, radius), _smooth(mark_ratio, radius)
    share = size / size.sum()
    score = np.sqrt((length_ratio / max((length_ratio * share).sum(), 1e-12)) * ((mark_ratio + 0.1) / ((mark_ratio + 0.1) * share).sum()))
    of_path = np.bincount(path, score) / count
    bound = threshold * (score * share).sum()
    kept = (of_path >= bound)[path]
    return "\n".join(t for t, k in zip(texts, kept.tolist(), strict=True) if k), int(kept.sum()), len(texts)


def _run(radius: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            done = [(None, 0, 0) if page is None else extract(page, radius, threshold) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], ["page_id", "url", "content", "kept_nodes", "all_nodes"])

    return run


def extract_pages(pages: DataFrame, radius: int = 1, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, content, kept_nodes, all_nodes) for every page.

    A null page has null content and no nodes; a page without visible text has empty content. Pages with
    text keep at least one path (the best scores above the mean). A page is read once from end to end, in time that
    grows with its length and whatever depth its tags have. Ids and addresses may be null or
    repeated: each row stands for itself. An empty table gives an empty one.
    """
    pages = only(pages, ["page_id", "url", "html"])
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_run(radius, threshold), f"page_id {kinds['page_id']}, url {kinds['url']}, content string, kept_nodes int, all_nodes int")
