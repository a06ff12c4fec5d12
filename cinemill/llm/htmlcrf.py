"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into leaf blocks: the texts between starts and ends of block elements, each with its
open ancestors. Features are ancestor tags, words and telling parts of ancestors' class and id, and the
block's own shape and its neighbours'. The field has two labels, article and other; it is trained on labelled pages by gradient
ascent on the likelihood, and the best labelling of a page is found by Viterbi's algorithm. Script,
style, head and other unseen text never becomes a block.

Defined cases: null or empty html gives an empty text; pages without blocks likewise; repeated rows
are handled each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import table
from cinemill.llm.htmlpages import labelled_pages

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[a-z]+")
#: What stands between links in a row.
BETWEEN = re.compile(r"[\s|·›»•/]+")
#: Parts of class names and ids that tell what an element is for, also inside longer words.
CUES = (
    "nav menu foot head side rail comment reply disqus cookie consent gdpr privacy overlay popup modal advert sponsor promo banner share social relat recommend widget crumb login search subscri newsletter "
    "content article post story entry body text main"
).split()
UNSEEN = frozenset("script style noscript template head title svg iframe object".split())
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option optgroup p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for m in NAMES.finditer(attributes) for w in LETTERS.findall((m[1] or m[2] or m[3] or "").lower())))


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, marks of the open ancestors, characters within links) of each leaf block in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[str, tuple[str, ...], int]] = []
    held: list[str] = []
    linked = at = 0
    unseen = 0
    links = 0

    def flush():
        nonlocal held, linked
        if held:
            raw = "".join(held)
            text = SPACE.sub(" ", raw).strip()
            if text:
                marks = dict.fromkeys(m for tag, names in stack for m in (tag, *names))
                out.append((text, (*marks, "own:" + next((t for t, _ in reversed(stack) if t in BLOCKS), "")), linked))
            held, linked = [], 0

    def pop_to(k: int):
        nonlocal unseen, links
        for tag, _ in stack[k:]:
            unseen -= tag in UNSEEN
            links -= tag == "a"
        del stack[k:]

    def say(raw: str):
        nonlocal linked
        if raw and not unseen:
            raw = htmllib.unescape(raw) if "&" in raw else raw
            held.append(raw)
            if links:
                linked += len(BETWEEN.sub("", raw))

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None and m[5] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                if any(t in BLOCKS for t, _ in stack[k:]):
                    flush()
                pop_to(k)
            continue
        if tag == "br":
            say("\n")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if unseen == 1 and tag != "html":  # a head left open ends here, unless another unseen element is open
                k = next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack))
                pop_to(k)
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), -1)
            if k >= 0 and not any(t in ("button", "table", "td") for t, _ in stack[k:]):
                pop_to(k)
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SCOPE[tag]:
                        break
                    if stack[k][0] in CLOSES[tag]:
                        pop_to(k)
                        break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and (tag not in UNSEEN or tag == "svg"):
            continue
        if tag == "body":
            pop_to(next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        stack.append((tag, _names(attributes) if attributes else ()))
        unseen += tag in UNSEEN
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            say(page[at : close.start()] if close else page[at:])
            at = close.start() if close else end
    flush()
    return out


@lru_cache(maxsize=4096)
def _cues(mark: str) -> tuple[str, ...]:
    return tuple(f"cue:{c}" for c in CUES if c in mark)


def _size(text: str) -> int:
    return min((text.count(" ") + 1).bit_length(), 7)


def _linked(block: tuple[str, tuple[str, ...], int]) -> int:
    share = block[2] / max(1, len(BETWEEN.sub("", block[0])))
    return min(int(share * 4), 3) if share < 0.99 else 4


def features(blocks: list[tuple[str, tuple[str, ...], int]], k: int) -> list[str]:
    """Features of the k-th block: its ancestors, its own shape, and its neighbours'."""
    text, marks, _ = block = blocks[k]
    out = [*marks, f"words:{_size(text)}", f"links:{_linked(block)}", f"commas:{min(text.count(','), 3)}"]
    out.append("stop" if text[-1] in ".!?:…" else "open")
    out += dict.fromkeys(c for m in marks for c in _cues(m))
    if text[-1] in ".!?…" and _size(text) > 3:
        out.append("sentence")
    if "©" in text or "copyright" in text[:200].lower():
        out.append("copyright")
    for name, at in (("before", k - 1), ("after", k + 1)):
        if 0 <= at < len(blocks):
            there = blocks[at]
            out += [f"{name}:words:{_size(there[0])}", f"{name}:links:{_linked(there)}"]
            if there[1] == marks:
                out.append(f"{name}:same")
        else:
            out.append("first" if at < 0 else "last")
    if not any(m in ("article", "main") for m in marks):
        out.append("outside")
    return out


class ChainField:
    """Two-label linear-chain conditional random field over sparse binary features."""

    STEPS, RATE, DECAY = 150, 0.08, 0.002

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.start, self.move = np.zeros(2), np.zeros((2, 2))

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], least: int = 3) -> "ChainField":
        seen: dict[str, int] = {}
        for page in pages:
            for block in page:
                for f in block:
                    seen[f] = seen.get(f, 0) + 1
        number = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
        longest = max(map(len, pages))
        x = np.zeros((len(pages), longest, len(number)), dtype=np.float32)
        y, live = np.zeros((len(pages), longest), dtype=int), np.zeros((len(pages), longest), dtype=bool)
        for i, (page, label) in enumerate(zip(pages, labels)):
            y[i, : len(page)], live[i, : len(page)] = label, True
            for j, block in enumerate(page):
                x[i, j, [number[f] for f in block if f in number]] = 1
        p = {"w": np.zeros(len(number)), "start": np.zeros(2), "move": np.zeros((2, 2))}
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        rows = np.arange(len(pages))
        ends = live.sum(1) - 1
        for t in range(1, self.STEPS + 1):
            u = np.stack([np.zeros(y.shape), x @ p["w"].astype(np.float32)], axis=2).astype(float)
            a, b = np.zeros(u.shape), np.zeros(u.shape)
            a[:, 0] = u[:, 0] + p["start"]
            for j in range(1, longest):
                step = np.logaddexp(*(a[:, j - 1, s, None] + p["move"][s] for s in (0, 1))) + u[:, j]
                a[:, j] = np.where(live[:, j, None], step, a[:, j - 1])
            total = np.logaddexp(a[rows, ends, 0], a[rows, ends, 1])
            move = np.zeros((2, 2))
            for j in range(longest - 2, -1, -1):
                nxt = p["move"][None] + (u[:, j + 1] + b[:, j + 1])[:, None, :]
                b[:, j] = np.where(live[:, j + 1, None], np.logaddexp(nxt[:, :, 0], nxt[:, :, 1]), 0)
                both = np.exp(a[:, j, :, None] + nxt - total[:, None, None])
                on = live[:, j + 1]
                move -= both[on].sum(0)
                np.add.at(move, (y[on, j], y[on, j + 1]), 1)
            one = np.exp(a[:, :, 1] + b[:, :, 1] - total[:, None])
            g = {
                "w": np.einsum("ij,ijf->f", ((y - one) * live).astype(np.float32), x),
                "start": np.array([(y[:, 0] == s).sum() - np.exp(a[:, 0, s] + b[:, 0, s] - total).sum() for s in (0, 1)]),
                "move": move,
            }
            for k in p:
                d = -(g[k] / len(pages)) + self.DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] -= self.RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.weight = {f: float(p["w"][i]) for f, i in number.items()}
        self.start, self.move = p["start"], p["move"]
        return self

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if not page:
            return []
        get, ((aa, ab), (ba, bb)) = self.weight.get, self.move.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = float(self.start[0]), float(self.start[1])
        for j, block in enumerate(page):
            u = sum(get(f, 0.0) for f in block)
            if j:
                from0, from1 = (0 if s0 + aa >= s1 + ba else 1), (0 if s0 + ab >= s1 + bb else 1)
                back.append((from0, from1))
                s0, s1 = max(s0 + aa, s1 + ba), max(s0 + ab, s1 + bb)
            s1 += u
        out = [int(s1 > s0)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def tagger(pages: list[tuple[str, list[tuple[str, int]]]]) -> ChainField:
    """A field trained on labelled pages: (html, [(block text, 1 if article)]) in page order."""
    xs, ys = [], []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels) and blocks:
            xs.append([features(blocks, k) for k in range(len(blocks))])
            ys.append([y for _, y in labels])
    return ChainField().fit(xs, ys)


def main_text(page: str, field: ChainField) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode([features(blocks, k) for k in range(len(blocks))])
    return "\n".join(b[0] for b, y in zip(blocks, labels) if y)


def extract(df: DataFrame, field: ChainField, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text string and n_chars long of every page."""
    rows = df.select(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"), *(F.col(f"`{c}`") for c in keep))
    schema = rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), field) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), tagger(labelled_pages()))
