"""Template deduction from equivalence classes of tokens, and extraction of what fills the slots."""

from __future__ import annotations

import html as entities
import json
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.llm.common import c, ship, written

#: Least share of a host's pages that a template token is on (half of it in any chunk), least pages of a host with a
#: template, least tokens of a class, pages that one task compares.
SUPPORT, MIN_PAGES, MIN_CLASS, CHUNK_PAGES = 0.8, 4, 2, 1024
#: Bytes of pages that a task compares, chunk after chunk, whatever the table's size.
TASK_BYTES = 16 << 20

_MARKUP = re.compile(r"(<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<[^<>]*>)", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z!?][^\s/>]*)")
_CLASS = re.compile(r"""\s(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@lru_cache(1 << 16)
def tag_token(tag: str) -> str:
    """A tag without what varies: its name, whether it closes, and its class or id."""
    low = tag[:8].lower()
    for mark, token in (("<!--", "<!-->"), ("<script", "<script/>"), ("<style", "<style/>")):
        if low.startswith(mark):
            return token
    m = _NAME.match(tag)
    if not m:
        return "<>"
    name = m[1].lower()
    if tag[1] == "/":
        return f"</{name}>"
    own = _CLASS.search(tag)
    return f"<{name} {own[1] or own[2] or own[3] or ''}>" if own else f"<{name}>"


#: Elements without an end, and those that a sibling of their name ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr ! !doctype <>".split())
_SIBLING = frozenset("li p td th tr dt dd option".split())


def page_tokens(page: str) -> tuple[list[str], list[str]]:
    """Tokens of a page in order, and their texts: tags (they start with <, text empty) and words.

    A token plays a role: it is told apart by the path of open elements that it stands in, so that </div> or a td of
    one table is another token than that of the next. Scripts, styles and comments are one token each.
    """
    out: list[str] = []
    said: list[str] = []
    stack: list[tuple[str, int]] = []
    at = 0
    parts = _MARKUP.split(page)
    for i, part in enumerate(parts):
        if i % 2:
            tag = tag_token(part)
            name = tag[1:].rstrip(">").split(" ")[0].rstrip("/")
            if tag.startswith("</"):
                name = tag[2:-1]
                k = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == name), None)
                if k is not None:
                    at = stack[k][1]
                    del stack[k:]
                out.append(f"{tag} {at:x}")
            else:
                if stack and name in _SIBLING and stack[-1][0] == name:
                    at = stack.pop()[1]
                out.append(f"{tag} {at:x}")
                if name not in _VOID and not part.endswith("/>") and tag[:4] not in ("<!--", "<scr", "<sty"):
                    stack.append((name, at))
                    at = crc32(tag.encode(), at)
            said.append("")
        elif part:
            for w in part.split():
                out.append(f"{'&lt;' + w[1:] if w[0] == '<' else w} {at:x}")
                said.append(w)
    return out, said


def _kept_order(m: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Rows (tokens) in their order, without those that are not in that order in every occurrence.

    m[token, j]: place of the token's jth occurrence over all pages. In every occurrence j the kept tokens follow
    one another, and all come before the first of the next occurrence on the same page.
    """
    order = np.argsort(m[:, 0], kind="stable")
    same = page[1:] == page[:-1]
    kept = [order[0]]
    for t in order[1:]:
        if (m[t] > m[kept[-1]]).all() and (m[t][:-1] < m[kept[0]][1:])[same].all():
            kept.append(t)
    return np.array(kept)


def chunk_classes(keys: np.ndarray, pages: list[list[str]], support: float, min_class: int = MIN_CLASS) -> pd.DataFrame:
    """Tokens of a chunk of one host's pages that are on enough of them.

    token, sig (a hash of its occurrence vector), pages it is on, occurrences, once (never twice on a page), place in
    its class's order (-1 if dropped from it), and nests: for each class of the chunk inside whose occurrences all of
    the token's lie, that class's sig and the least and largest place of its token before it.
    """
    columns = ["token", "sig", "pages", "met", "once", "place", "nests"]
    n = len(pages)
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(t, len(names)) for p in pages for t in p), np.int64)
    page = np.repeat(np.arange(n), [len(p) for p in pages])
    if not len(ids):
        return pd.DataFrame(columns=columns)
    on, count = np.unique(ids * n + page, return_counts=True)
    held = np.bincount(on // n, minlength=len(names))
    often = np.flatnonzero(held >= max(1, np.ceil(support / 2 * n)))
    word = list(names)
    some = np.flatnonzero(np.isin(ids, often))
    spots = some[np.argsort(ids[some], kind="stable")]  # of each frequent token, in order of tokens
    starts = np.searchsorted(ids[spots], often)
    where = dict(zip(often, np.split(spots, starts[1:])))
    vectors: dict[bytes, list[int]] = {}
    for t in often:
        v = np.zeros(n, np.int64)
        lo, hi = np.searchsorted(on, [t * n, (t + 1) * n])
        v[on[lo:hi] - t * n] = count[lo:hi]
        vectors.setdefault(v.tobytes(), []).append(t)
    rows, nests = [], {t: [] for t in often}
    for raw, members in vectors.items():
        v = np.frombuffer(raw, np.int64)
        m = np.stack([where[t] for t in members])
        kept = _kept_order(m, page[m[0]])
        sig = int(np.bitwise_xor.reduce(pd.util.hash_array(keys.astype(np.int64) * 1_000_003 + v)[v > 0].astype(np.uint64)).astype(np.int64))
        place = {members[i]: p for p, i in enumerate(kept)}
        rows += [(t, sig, int((v > 0).sum()), int(v.sum()), bool(v.max() == 1), place.get(t, -1)) for t in members]
        if len(kept) >= min_class:
            flat = m[kept].ravel()
            order = np.argsort(flat)
            flat, places = flat[order], np.repeat(np.arange(len(kept)), m.shape[1])[order]
            j = np.searchsorted(flat, spots, side="right") - 1
            gap = np.where((j >= 0) & (page[flat[np.maximum(j, 0)]] == page[spots]), places[j], -1)
            for t, lo, hi in zip(often, np.minimum.reduceat(gap, starts), np.maximum.reduceat(gap, starts)):
                if lo >= 0 and t not in place:
                    nests[t].append({"sig": sig, "lo": int(lo), "hi": int(hi)})
    return pd.DataFrame([(word[t], sig, pages_, met, once, at, nests[t]) for t, sig, pages_, met, once, at in rows], columns=columns)


def assemble(rows: pd.DataFrame, pages: int, chunks: int, support: float = SUPPORT, min_class: int = MIN_CLASS) -> dict | None:
    """A host's template out of its chunks' tokens: classes, each with its tokens, the class it is nested in and where.

    Tokens have one occurrence vector over the host if they have one in every chunk. A class keeps tokens whose order
    all chunks agree on. The root is the class, once on a page, of most support. Another is nested in a class if all
    its occurrences fall between the same two of its tokens (or after the root's last), and so that this one hangs
    from the root itself; of several such classes, in the one that occurs most often.
    """
    rows = rows[rows["place"] >= 0]
    by: dict[tuple, list[tuple[str, dict]]] = {}
    for token, part in rows.groupby("token", sort=True):
        if len(part) == chunks and part["pages"].sum() >= support * pages:
            part = part.sort_values("chunk")
            within = [{x["sig"]: (x["lo"], x["hi"]) for x in nest} for nest in part["nests"]]
            by.setdefault(tuple(part["sig"]), []).append((token, {"place": part["place"].to_numpy(), "within": within, "once": bool(part["once"].all()), "pages": int(part["pages"].sum()), "met": int(part["met"].sum())}))
    classes = []
    for sigs, members in by.items():
        members.sort(key=lambda x: (int(x[1]["place"][0]), x[0]))
        kept = [members[0]]
        for x in members[1:]:
            if (x[1]["place"] > kept[-1][1]["place"]).all():
                kept.append(x)
        if len(kept) >= min_class:
            classes.append((sigs, kept))
    once = [k for k in classes if k[1][0][1]["once"]]
    if not once:
        return None
    root = max(once, key=lambda k: (k[1][0][1]["pages"] * len(k[1]), k[1][0][0]))
    rest = sorted((k for k in classes if k is not root), key=lambda k: (k[1][0][1]["met"], k[1][0][0]))

    def gap(inner: tuple, outer: tuple) -> int | None:
        """Between which of the outer class's tokens all of the inner one's lie."""
        found = set()
        for _, x in inner[1]:
            for e, sig in enumerate(outer[0]):
                if sig not in x["within"][e]:
                    return None
                own = [y["place"][e] for _, y in outer[1]]  # the chunk's class may hold more tokens than the host's
                found |= {int(np.searchsorted(own, v, side="right")) - 1 for v in x["within"][e][sig]}
        at = found.pop()
        return at if not found and 0 <= at < len(outer[1]) - (outer is not root) else None

    placed, out = [root], [{"tokens": [x[0] for x in root[1]], "in": -1, "gap": -1}]
    todo = list(rest)
    while todo:  # a class is placed once what it is nested in is; those in no class of the template stay out
        ready = [(k, [(j, g) for j, other in enumerate(placed) if (g := gap(k, other)) is not None]) for k in todo]
        waits = [k for k, _ in ready if any(other is not k and gap(k, other) is not None and any(gap(other, y) is not None for y in placed) for other in todo)]
        chosen = [(k, max(found, key=lambda x: (placed[x[0]][1][0][1]["met"], -x[0]))) for k, found in ready if found and k not in waits]
        if not chosen:
            break
        for k, (j, g) in chosen:
            placed.append(k)
            out.append({"tokens": [x[0] for x in k[1]], "in": j, "gap": g})
        todo = [k for k in todo if all(k is not x for x, _ in chosen)]
    return {"classes": out}


def extract(tokens: list[str], said: list[str], template: dict | None) -> list[tuple[int, list[int], str]]:
    """(slot, path, text) of what the template doesn't hold.

    Slot s lies after the sth root token (from 0; -1 before the first). path has, for each class that the text is
    nested in, from the outermost, which repeat of it since the slot or part began (from 1), and after which of its
    tokens (from 1). Other tags only part words.
    """
    classes = template["classes"] if template else []
    known = {t: (k, i) for k, x in enumerate(classes) for i, t in enumerate(x["tokens"])}
    out: list[tuple[int, list[int], str]] = []
    # a frame is an open class: its number, the place of its last token, which repeat it is, and repeats met inside
    frames: list[list] = [[0, -1, 0, {}]]
    words: list[str] = []

    def flush() -> None:
        nonlocal words
        if words:
            out.append((frames[0][1], [y for f in frames[1:] for y in (f[2], f[1] + 1)], entities.unescape(" ".join(words))))
            words = []

    for t, w in zip(tokens, said):
        k, i = known.get(t, (-1, -1))
        if k == 0 and i > frames[0][1]:
            flush()
            frames = [[0, i, 0, {}]]
            continue
        if k > 0:
            depth = next((d for d, f in enumerate(frames) if f[0] == classes[k]["in"] and f[1] == classes[k]["gap"]), None)
            if depth is not None:
                flush()
                own = frames[depth + 1] if depth + 1 < len(frames) and frames[depth + 1][0] == k else None
                if own is None or i <= own[1]:
                    met = frames[depth][3]
                    met[k] = met.get(k, 0) + 1
                    own = [k, i, met[k], {}]
                else:
                    own = [k, i, own[2], {}]
                frames = [*frames[: depth + 1], own]
                continue
        if w:
            words.append(w)
    flush()
    return out


def deduce(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """host, template (JSON) and its tokens, from columns key, host and html."""
    ship(pages.sparkSession)
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("held"), F.count("html").alias("some"), F.sum(F.octet_length("html")).alias("bytes")).where((F.col("held") >= min_pages) & (F.col("host") != "")).select("host", "held", "bytes", F.greatest(F.lit(1), F.ceil(F.col("some") / chunk_pages)).cast("int").alias("chunks")), "html-hosts")
    tasks = max(1, -(-(hosts.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    parted = pages.where("html is not null").join(hosts.drop("bytes"), "host").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))

    def classes(group: pa.Table) -> pa.Table:
        got = chunk_classes(group["key"].to_numpy(), [page_tokens(p.as_py())[0] for p in group["html"]], support)
        if not len(got):  # the chunk is told of though no token is frequent in it
            got = pd.DataFrame([("", 0, 0, 0, False, -1, [])], columns=got.columns)
        first = {x: group[x][0].as_py() for x in ("host", "chunk", "held", "chunks")}
        got = got.assign(**first, seen=group.num_rows)
        return pa.Table.from_pandas(got, schema=_CLASSES, preserve_index=False)

    def template(group: pa.Table) -> pa.Table:
        rows = group.to_pandas()
        seen = int(rows.groupby("chunk")["seen"].first().sum())
        made = assemble(rows, seen, rows["chunk"].nunique(), support)  # of the chunks, those that hold pages
        size = sum(len(k["tokens"]) for k in made["classes"]) if made else 0
        return pa.table({"host": [rows["host"].iloc[0]], "template": pa.array([json.dumps(made, ensure_ascii=False) if made else None], pa.string()), "n_template": pa.array([size], pa.int32())})

    # the counts go back to each chunk through the join; pages travel once, by (host, chunk)
    found = parted.select("key", "host", "html", "chunk", "held", "chunks").repartition(tasks, "host", "chunk").groupBy("host", "chunk").applyInArrow(classes, "token string, sig bigint, pages bigint, met bigint, once boolean, place int, nests array<struct<sig:bigint,lo:int,hi:int>>, host string, chunk int, held bigint, chunks int, seen bigint")
    return written(found.groupBy("host").applyInArrow(template, "host string, template string, n_template int").where("template is not null"), "html-templates")


_CLASSES = pa.schema([("token", pa.string()), ("sig", pa.int64()), ("pages", pa.int64()), ("met", pa.int64()), ("once", pa.bool_()), ("place", pa.int32()), ("nests", pa.list_(pa.struct([("sig", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))), ("host", pa.string()), ("chunk", pa.int32()), ("held", pa.int64()), ("chunks", pa.int32()), ("seen", pa.int64())])


def slots(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """Extract every page's slots under its host's template: page_id, host, n_template, slots.

    Tokens are tags (name and class) and words, told apart by the elements they stand in. Those of a host that have the
    same occurrence vector (how often on each of its pages) form an equivalence class; a class counts if its tokens
    keep one order in every occurrence. The class of tokens once on a page with the most support is the root; classes
    whose occurrences all fall into one gap of another are nested there, at any depth. slots holds (slot, path, text)
    of all text outside the template; see extract().

    Pages travel once, to (host, chunk) groups of some CHUNK_PAGES, so a hot host is many tasks; chunks pass on their
    frequent tokens alone, with a hash of the occurrence vector, and a host's rows meet in one small group. The second
    pass joins templates to pages where they lie.

    Nulls: a null page has null slots, an empty one none. Pages without a host, and hosts of fewer than min_pages
    pages or without a valid class, have no template (n_template 0): all their text is slot -1. Repeated rows count
    as pages of their own and are each extracted. Very long pages are read whole; ties between classes go by
    token. Other columns are not carried, so none clash. No rows give no rows.
    """
    ship(pages.sparkSession)
    rows = pages.select(c(key).alias("page_id"), F.xxhash64(c(key), c(url)).alias("key"), F.lower(F.coalesce(F.try_parse_url(c(url), F.lit("HOST")), F.lit(""))).alias("host"), c(html).alias("html"))
    templates = deduce(rows.select("key", "host", "html"), support, min_pages)

    @F.arrow_udf("array<struct<slot:int,path:array<int>,text:string>>")
    def filled(page: pa.Array, template: pa.Array) -> pa.Array:
        known: dict = {None: None}
        out = []
        for p, t in zip(page, template.to_pylist()):
            if t not in known:
                known[t] = json.loads(t)
            p = p.as_py()
            out.append(None if p is None else [dict(zip(("slot", "path", "text"), x)) for x in extract(*page_tokens(p), known[t])])
        return pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("path", pa.list_(pa.int32())), ("text", pa.string())])))

    both = rows.join(templates, "host", "left")
    return both.select("page_id", "host", F.coalesce("n_template", F.lit(0)).alias("n_template"), filled("html", "template").alias("slots"))
