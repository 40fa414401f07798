"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block becomes a vector:
embeddings of its hashed tag path (tags, class, id and role words, pairs of
neighbours on the path), of its hashed words, and a few measures. A
bidirectional LSTM in numpy reads the whole sequence, so every block is
classified with the page around it; the blocks labelled as article are the text.

The model is trained here, on at most ``TRAIN_PAGES`` pages (those whose ids
hash lowest), labelled by their own markup where they say what is article, and
on ``MADE_PAGES`` layouts put together from those pages' blocks by the fixed
lists below. It has a fixed size and is broadcast. Pages are independent: one
scan, no shuffle, batches of ``BATCH`` pages of like length at a time.

Defined cases: null or empty html has an empty text; a page without markup is
one block; repeated rows and null ids are pages like any other; very long pages
are read whole; extra columns are not read; an empty table gives an empty
result (and a model of made layouts of filler words alone).
"""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import col
from equigroup.llm.html_blocks import along, blocks

TRAIN_PAGES, MADE_PAGES, EPOCHS, BATCH = 300, 1800, 12, 128
#: Pages times blocks that are labelled at a time, unless one page has more.
BATCH_CELLS = 1 << 16
PATHS, WORDS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 2048, 1024, 24, 6, 4, 20

# Fixed lists: elements that hold the parts of a page, as tag and class words.
PARTS = {
    "menu": ["nav", "nav.menu", "ul.menu", "div.navbar", "div.navigation", "div.menu", "div.breadcrumb", "ol.breadcrumbs",
             "div.topnav", "div.toolbar", "div.tabs", "nav.pagination", "div.pager", "div.toc"],
    "header": ["header", "div.header", "div.masthead", "div.site header", "div.topbar", "div.logo", "div.banner", "header.site"],
    "footer": ["footer", "div.footer", "div.colophon", "div.copyright", "div.site footer", "div.legal", "div.bottom"],
    "side": ["aside", "div.sidebar", "aside.widget", "div.widget", "div.related", "div.secondary", "div.recommended", "div.share",
             "div.social", "div.tags", "div.author", "section.more", "div.trending", "div.popular"],
    "notice": ["div.notice", "div.cookie", "div.cookie consent", "div.alert", "div.gdpr", "div.popup", "div.modal", "dialog",
               "div.newsletter", "div.paywall", "div.message", "div.warning", "p.disclaimer", "div.privacy", "aside.notice", "p.notice"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "ins.adsbygoogle",
               "aside.promo", "div.sponsor", "section.advert", "p.ad", "span.ad", "aside.ad", "div.promotion"],
    "form": ["form", "form.search", "div.search form", "form.subscribe", "div.login form", "form.newsletter", "fieldset"],
    "comments": ["section.comments", "div.comments", "ol.comment list", "div.comment", "div.reply", "section.responses",
                 "div.disqus", "ul.comments", "div.discussion", "article.comment", "section.reviews", "div.thread"],
}
HOLDERS = ["article", "article", "article", "article", "main", "main", "article.post", "div.article", "div.content", "div.post", "div.entry content", "div.article body",
           "div.story", "section.body", "main.content", "div.main", "div.text", "section.article"]
# Fixed list: marks that say what a part is, for the labels of real pages.
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "label", "fieldset", "title", "head", "dialog", "menu"}
BOILER_WORDS = {w for kind in PARTS.values() for part in kind for w in part.partition(".")[2].split()} - {"site", "header list", "author", "tags", "text", "list", "message", "more", "content"}


def markup_labels(page: list) -> list[int] | None:
    """1 for blocks inside an article or main element and no part of
    ``PARTS``; None for pages that have no such element."""
    inside, other = {}, {}
    inside = [along(path, inside, False, lambda v, p: v or p.marks[0] in ("article", "main")) for path, _, _ in page]
    if not any(inside):
        return None
    other = [along(path, other, False, lambda v, p: v or p.marks[0] in BOILER_TAGS or any(w[1:] in BOILER_WORDS for w in p.marks[1:]))
             for path, _, _ in page]
    return [int(i and not o) for i, o in zip(inside, other)]


def hide_holders(html: str, rng: random.Random) -> str:
    """The page with its article and main elements as elements that don't say so."""
    name = rng.choice(["div", "section"])
    mark = rng.choice(["", f' class="{nonsense(rng)}"'])
    return re.sub(r"<(/?)(?:article|main)\b[^>]*>", lambda m: f"</{name}>" if m[1] else f"<{name}{mark}>", html, flags=re.I)


def nonsense(rng: random.Random) -> str:
    """A class word that says nothing."""
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, 7)))


def _open(holder: str, rng: random.Random) -> tuple[str, str]:
    """Opening and closing markup of 'tag.words' (words after a blank in the
    tag part are a nested tag)."""
    name, _, words = holder.partition(".")
    parts = words.split()
    nested = parts.pop() if parts and parts[-1] == "form" else None
    if parts and rng.random() < 0.4:  # words of a site's own beside the known ones, at times instead of them
        parts.insert(rng.randint(0, len(parts)), nonsense(rng))
        if rng.random() < 0.1:
            parts = [nonsense(rng)]
    kind = rng.choice(["class", "class", "id"])
    value = rng.choice(["-", " ", "_"]).join(parts)
    mark = f' {kind}="{value}"' if parts else ""
    if not parts and rng.random() < 0.2:
        mark = f' {rng.choice(["class", "id", "style"])}="{rng.choice(["x", "c1", "box", "wrap", "row", "inner", "s2"])}"'
    return f"<{name}{mark}>" + (f"<{nested}>" if nested else ""), (f"</{nested}>" if nested else "") + f"</{name}>"


def made_page(rng: random.Random, long: list[str], short: list[str]) -> tuple[str, list[int]]:
    """A page put together from block texts, and its blocks' labels."""
    out, labels = [], []
    plain = rng.random()
    if plain < 0.04:  # no markup, or hardly any
        body = " ".join(rng.choice(long if rng.random() < 0.7 else short).replace("&", "&amp;").replace("<", "&lt;") for _ in range(rng.randint(1, 3)))
        return rng.choice(["{}", "{}", "<body>{}</body>", "<html><body>{}</body></html>", "<p>{}", "<div>{}</div>"]).format(body), [1]

    def text(words: list[str]) -> str:
        return rng.choice(words).replace("&", "&amp;").replace("<", "&lt;")

    def block(tag: str, words: list[str], label: int, link: bool = False) -> None:
        body = f'<a href="/{rng.randrange(99)}">{text(words)}</a>' if link else text(words)
        out.append(f"<{tag}>{body}</{tag}>")
        labels.append(label)

    def part(kind: str) -> None:
        holder = rng.choice(PARTS[kind])
        before, after = _open(holder, rng)
        if holder.partition(".")[0] in ("p", "span"):  # these hold words, no blocks
            out.append(f"{before}{text(short)}{after}<hr>")
            labels.append(0)
            return
        inner = {"menu": ["ul", "ul", "ol", "div"], "comments": ["div", "ul", "section"]}.get(kind)
        inner = rng.choice(inner) if inner and rng.random() < 0.5 else None
        out.append(before + (f"<{inner}>" if inner else ""))
        n = rng.randint(1, 6 if kind in ("menu", "comments") else 3)
        for _ in range(n):
            if kind == "menu":
                block("li", short, 0, True)
            elif kind == "form":
                block(rng.choice(["label", "button", "p", "option", "legend"]), short, 0)
            else:
                block(rng.choice(["p", "p", "div", "li", "h3", "span"] if n == 1 else ["p", "div", "li", "h3"]),
                      long if rng.random() < 0.5 else short, 0, rng.random() < 0.2)
        out.append((f"</{inner}>" if inner else "") + after)

    for kind in ("header", "menu", "notice", "advert", "form", "side"):
        if rng.random() < 0.45:
            part(kind)
    if rng.random() < 0.35:  # a site's own names: nothing but what it holds tells what a part is
        hidden = f'<{(name := rng.choice(["div", "section"]))}{rng.choice(["", " class=" + nonsense(rng), " id=" + nonsense(rng)])}>', f"</{name}>"
    else:
        hidden = None
    wraps = [_open(rng.choice(["div", "div.wrapper", "div.container", "section", "div.page"]), rng) for _ in range(rng.randint(0, 2))]
    holder = hidden or _open(rng.choice(HOLDERS), rng)
    out += [w[0] for w in wraps]
    if rng.random() < 0.3:
        part("side")
    out.append(holder[0])
    brief = rng.random() < 0.2  # a page of short texts
    if rng.random() < 0.7:
        block(rng.choice(["h1", "h1", "h2"]), short, 1)
    for _ in range(rng.randint(1, 3 if rng.random() < 0.3 else 10)):
        x = rng.random()
        if x < 0.07:
            part(rng.choice(["advert", "side", "notice", "form"]))
        elif x < 0.12:  # words in the holder itself, a formula, a caption
            tag = rng.choice(["", "", "math", "figcaption", "dd"])
            if tag in ("", "math"):
                body = text(long if rng.random() < 0.4 else short)
                out.append(f"<hr>{f'<math><mi>{body}</mi></math>' if tag else body}<hr>")
                labels.append(1)
            else:
                block(tag, short, 1)
        elif x < 0.19:
            block(rng.choice(["h2", "h3", "h4"]), short, 1)
        elif x < 0.26:
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>")
            for _ in range(rng.randint(1, 4)):
                block("li", short if rng.random() < 0.6 else long, 1)
            out.append(f"</{tag}>")
        elif x < 0.31:
            out.append("<table><tr>")
            for _ in range(rng.randint(1, 3)):
                block("td", short, 1)
            out.append("</tr></table>")
        else:
            block(rng.choice(["p", "p", "p", "p", "blockquote", "pre", "div"]), short if brief or rng.random() < 0.2 else long, 1)
    if rng.random() < 0.35:
        part("comments")
    out.append(holder[1])
    out += [w[1] for w in reversed(wraps)]
    for kind in ("comments", "side", "advert", "notice", "form", "menu", "footer"):
        if rng.random() < 0.4:
            part(kind)
    page = "".join(out)
    return page if rng.random() < 0.2 else f"<html><body>{page}</body></html>", labels


class Hashes(dict):
    """word -> its bucket, kept for reuse and emptied when large."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8")) % self.buckets
        return h


def vectors(page: list, path_hash: Hashes, word_hash: Hashes) -> tuple[list, list, np.ndarray]:
    """Buckets of each block's path, buckets of its words, and measures."""
    paths, words, measures = [], [], np.empty((len(page), MEASURES), np.float32)
    known: dict = {}

    def grown(around: frozenset, p) -> frozenset:
        new = {path_hash[w] for w in p.marks}
        if p.up is not None:
            new.add(path_hash[f"{p.up.marks[0]}>{p.marks[0]}"])
        return around if new <= around else around | new

    for i, (path, text, linked) in enumerate(page):
        own = {path_hash["last " + w] for w in path.marks} if path is not None else set()
        paths.append(sorted(own | along(path, known, frozenset(), grown)))
        w = text.split()
        words.append([word_hash[x] for x in w])
        measures[i] = (np.log1p(len(text)) / 4, linked, text.count(".") / (len(w) + 1), (i + 1) / len(page))
    return paths, words, measures


def _bag(table: np.ndarray, keys: list[list[int]], power: float) -> np.ndarray:
    """Sum of the rows of ``table`` that each list names, over a power of
    their number (zero for none): 1 for words, whose number may be large."""
    n = np.array([len(k) for k in keys], np.int64)
    out = np.zeros((len(keys), table.shape[1]), np.float32)
    if n.sum():
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys if len(k)])
        starts = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
        out[n > 0] = np.add.reduceat(table[flat], starts, axis=0) / (n[n > 0] ** power)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + MEASURES
    model = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)),
             "out": rng.normal(0, 0.2, (2 * HIDDEN + d, 1)), "bias": np.zeros(1)}
    for way in ("f", "b"):
        model["w" + way] = rng.normal(0, 0.25, (d + HIDDEN, 4 * HIDDEN))
        model["a" + way] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in model.items()}


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, a: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states of x (steps, pages, inputs); where mask is 0 the state
    stays. What training needs of each step is kept only with ``keep``."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = np.concatenate([x[t], h], 1)
        g = z @ w + a
        s, u = _sigmoid(g[:, :3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN:])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        new = f * c + i * u
        th = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            kept.append((z, i, f, o, u, c, th, m))
        c = m * new + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[t] = h
    return out, kept


def _lstm_back(grad: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, weights and offsets."""
    steps, n, _ = grad.shape
    dw, da = np.zeros_like(w), np.zeros(w.shape[1], np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    d = w.shape[0] - HIDDEN
    dx = np.empty((steps, n, d), np.float32)
    for t in range(steps - 1, -1, -1):
        z, i, f, o, u, c, th, m = kept[t]
        total = dh + grad[t]
        now, cell = m * total, m * dc
        cell = cell + now * o * (1 - th * th)
        g = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), now * th * o * (1 - o), cell * i * (1 - u * u)], 1)
        dw += z.T @ g
        da += g.sum(0)
        back = g @ w.T
        dx[t] = back[:, :d]
        dh = back[:, d:] + (1 - m) * total
        dc = cell * f + (1 - m) * dc
    return dx, dw, da


def _padded(pages: list, model: dict, heard: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (steps, pages, inputs) and mask of vectorised pages. ``heard``
    says which blocks' words count (training leaves out half); by default all
    count half."""
    steps = max(len(p[0]) for p in pages)
    x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    words = _bag(model["word"], [k for p in pages for k in p[1]], 1.0)
    rows = np.concatenate([_bag(model["path"], [k for p in pages for k in p[0]], 0.5),
                           words * (0.5 if heard is None else heard[:, None]), np.concatenate([p[2] for p in pages])], 1)
    at = 0
    for j, p in enumerate(pages):
        x[:len(p[0]), j], mask[:len(p[0]), j] = rows[at:at + len(p[0])], 1
        at += len(p[0])
    return x, mask


def forward(pages: list, model: dict, heard: np.ndarray | None = None, keep: bool = True):
    x, mask = _padded(pages, model, heard)
    hf, kf = _lstm(x, mask, model["wf"], model["af"], keep)
    hb, kb = _lstm(x[::-1], mask[::-1], model["wb"], model["ab"], keep)
    features = np.concatenate([hf, hb[::-1], x], 2)
    return _sigmoid((features @ model["out"])[:, :, 0] + model["bias"][0]), (x, mask, features, kf, kb)


def train(pages: list, labels: list[list[int]], epochs: int = EPOCHS, batch: int = 32, seed: int = 5, rate: float = 0.01) -> dict:
    """Adam on the mean cross entropy of all blocks."""
    model = new_model(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    rng = np.random.default_rng(seed)
    full = [i for i, p in enumerate(pages) if p[0]]
    for epoch in range(epochs):
        order = sorted(full, key=lambda i: len(pages[i][0]) + 3 * rng.random())
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for g in [groups[i] for i in rng.permutation(len(groups))]:
            part = [pages[i] for i in g]
            heard = (rng.random(sum(len(q[0]) for q in part)) < 0.5).astype(np.float32)
            p, (x, mask, features, kf, kb) = forward(part, model, heard)
            y = np.zeros_like(p)
            for j, i in enumerate(g):
                y[:len(labels[i]), j] = labels[i]
            d = ((p - y) * mask / mask.sum())[:, :, None]
            grad = {"out": np.einsum("tnf,tno->fo", features, d), "bias": d.sum((0, 1))}
            df = d @ model["out"].T
            dx1, grad["wf"], grad["af"] = _lstm_back(df[:, :, :HIDDEN], kf, model["wf"])
            dx2, grad["wb"], grad["ab"] = _lstm_back(df[::-1, :, HIDDEN:2 * HIDDEN], kb, model["wb"])
            dx = dx1 + dx2[::-1] + df[:, :, 2 * HIDDEN:]
            flat = np.concatenate([dx[:len(q[0]), j] for j, q in enumerate(part)])
            flat[:, PATH_DIM:PATH_DIM + WORD_DIM] *= heard[:, None]
            for name, at, dim, k, power in (("path", 0, PATH_DIM, 0, 0.5), ("word", PATH_DIM, WORD_DIM, 1, 1.0)):
                grad[name] = np.zeros_like(model[name])
                keys = [b for q in part for b in q[k]]
                n = np.array([len(b) for b in keys])
                rows = np.repeat(flat[:, at:at + dim] / (np.maximum(n, 1) ** power)[:, None], n, axis=0)
                np.add.at(grad[name], np.concatenate([np.asarray(b, np.int64) for b in keys]), rows)
            step += 1
            now = rate * (1 - epoch / epochs)
            for name, g_ in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g_
                second[name] = 0.99 * second[name] + 0.01 * g_ * g_
                model[name] = (model[name] - now * (first[name] / (1 - 0.9 ** step))
                               / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return model


def fit_labeller(pages: DataFrame, train_pages: int = TRAIN_PAGES, made_pages: int = MADE_PAGES, id_col: str = "page_id",
                 html_col: str = "html", seed: int = 5) -> dict:
    """The model; at most ``train_pages`` pages come to the driver."""
    src = pages.select(col(id_col).cast("long").alias("id"), col(html_col).cast("string").alias("html"))
    ids = src.where("id IS NOT NULL AND html IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(train_pages)
    sample = src.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("html").alias("html")).orderBy("id")
    path_hash, word_hash, rng = Hashes(PATHS), Hashes(WORDS), random.Random(seed)
    x, y, long, short = [], [], [], []
    for row in sample.toLocalIterator():
        page = blocks(row["html"])
        for _, text, _ in page:
            (long if len(text) > 100 else short).append(text)
        labels = markup_labels(page)
        if labels:
            x.append(vectors(page, path_hash, word_hash))
            y.append(labels)
            x.append(vectors(blocks(hide_holders(row["html"], rng)), path_hash, word_hash))
            y.append(labels)
    filler = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "." for n in (3, 5, 8, 30, 60)]
    long, short = long or filler[3:], short or filler[:3]
    for _ in range(made_pages):
        html, labels = made_page(rng, long, short)
        page = blocks(html)
        assert len(page) == len(labels)
        x.append(vectors(page, path_hash, word_hash))
        y.append(labels)
    return train(x, y, seed=seed)


def extract_text(htmls: list, model: dict, path_hash: Hashes, word_hash: Hashes) -> list[str]:
    """The main text of each page, in the order given."""
    pages = [blocks(h or "") for h in htmls]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        n = 1  # pages are padded to the longest, the last
        while n < BATCH and k + n < len(order) and (n + 1) * len(pages[order[k + n]]) <= BATCH_CELLS:
            n += 1
        part = order[k:k + n]
        k += n
        p, _ = forward([vectors(pages[i], path_hash, word_hash) for i in part], model, keep=False)
        for j, i in enumerate(part):
            out[i] = " ".join(b[1] for b, s in zip(pages[i], p[:len(pages[i]), j]) if s >= 0.5)
    return out


def extract_main(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        path_hash, word_hash, m = Hashes(PATHS), Hashes(WORDS), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * BATCH):
                part = batch.slice(at, 8 * BATCH)
                text = extract_text(part.column("html").to_pylist(), m, path_hash, word_hash)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    src = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
                       col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
