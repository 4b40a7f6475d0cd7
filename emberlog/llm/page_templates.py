"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its containers with their path (tag, class words or else the number among
equal siblings) and its texts with their path of tags. Tokens of a host with the same occurrence
vector over the host's pages (equal counts on every page) form an equivalence class. A class is
valid if it spans at least two and more than half of the host's pages. Texts in valid classes
belong to the template and are taken out, wherever they stand; what remains are the slots. The
article's slot is found by how much slot text containers of valid classes hold: an article with
more than half of it, else the deepest container with nine tenths, or a main below that with
more than half. Tag and class words (DROPPED, ASIDE) only decide on slot text within it.

Vectors are compared by an XOR of digests of (page, count). Pages of a host with the same bytes
are one page here, so a copy is no witness for a template. Pages are read twice and never
shuffled with their text; the templates, one row per host, are joined by the size Spark sees. A
template has less than 1 / SUPPORT times as many texts as the host's pages have on average.

Elements without text to read (SILENT: pictures, players, buttons and the like) are passed over up to
their end; one that is left open, or closed by "/>", costs nothing behind it. Formulas are text.

A null page has an empty text; a null url is a host of its own. A page unlike its host's
template, and one without any slot text (all of it stands on most pages of the host), falls back
on its own article, main or body. Repeated rows are pages of their own in the result. Extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import extend, query, small_batches, table
from emberlog.llm.shingling import lots

SUPPORT = 0.5  # a class must span more than this share of a host's pages, and two pages

#: Element names and class words by their meaning in HTML.
CONTAINERS = set("html body main article section div nav header footer aside form ul ol dl table figure details dialog menu fieldset".split())
BLOCKS = CONTAINERS | set(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr address figcaption center summary title head".split())
DROPPED = set("nav header footer aside form menu dialog head title".split())
RAW = "script|style|textarea"
#: Elements without text to read; they end at their end tag, at "/>", or with the block they stand in.
SILENT = set("noscript template iframe svg canvas object select button video audio".split())
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|sidebar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|"
    r"notice|alert|popup|modal|newsletter|subscribe|share|social|related|recommended|comments?|replies|disqus|footer|header|masthead|widget)(?:$|[\s_-])", re.I)

PIECE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
CLASSES = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def walk(page):
    """(path, tags, mark, text) of every container (no text) and block of a page, in order.

    ``path`` is the tuple of open containers, each with its class words or its number among siblings
    without any; ``tags`` has their names. What stands in silent elements is passed over. ``mark`` is the depth of the deepest container that is no
    content by its tag or class words, 0 if there is none.
    """
    stack, held, out = [], [], []
    inside = [Counter()]  # of each open container, the children so far
    silent = []  # of each open silent element, its name and the blocks opened in it

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                mark = next((d for d in range(len(stack), 0, -1) if stack[d - 1][2]), 0)
                out.append((tuple(x[1] for x in stack), tuple(x[0] for x in stack), mark, text))

    for m in PIECE.finditer(page):
        if (text := m[5]) is not None:
            if not silent:
                held.append(entities.unescape(text))
            continue
        if m[3] is None:
            continue
        name, closed = m[3].lower(), m[4].rstrip().endswith("/")
        if name in SILENT:
            if m[2] and any(x[0] == name for x in silent):
                while silent.pop()[0] != name:
                    pass
            elif not m[2] and not closed:
                silent.append((name, Counter()))
            continue
        if silent:
            if not m[2] or name not in BLOCKS:
                silent[-1][1][name] += 1
                continue
            while silent and not silent[-1][1][name]:  # the end of a block around it ends an element left open
                silent.pop()
            if silent:
                silent[-1][1][name] -= 1
                continue
        if name == "br":
            held.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if name not in CONTAINERS and name not in DROPPED:
            continue
        if m[2]:
            if any(x[0] == name for x in stack):
                while True:
                    inside.pop()
                    if stack.pop()[0] == name:
                        break
        elif not closed:
            away = name in DROPPED or any(ASIDE.search(x.strip("\"'")) for x in MARKED.findall(m[4])) and name not in ("html", "body", "article", "main")
            label = name
            if found := CLASSES.search(m[4]):
                label = ".".join([name, *sorted(set(re.sub(r"\d{3,}", "0", found[1].strip("\"'").replace("/", "")).split()))])
            if label == name:
                inside[-1][name] += 1
                if (nth := inside[-1][name]) > 1:
                    label = f"{name}[{nth}]"
            stack.append((name, label, away))
            inside.append(Counter())
            out.append((tuple(x[1] for x in stack), (), 0, None))
    flush()
    return out


def text_token(tags, text):
    """Digest of a text and its path of tags, never 0."""
    return int.from_bytes(hashlib.blake2b("/".join((*tags, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def main_text(blocks, path, template=frozenset()):
    """Slot text below the template's ``path``, else below the page's own article, main or body; a page without slot text keeps its own."""
    def below(blocks, path):
        def cut(keep, depth=0):
            return [t for p, tags, mark, t in blocks if mark <= depth and keep(p, tags)]

        found = cut(lambda p, tags: p[: len(path)] == path, len(path)) if path else []
        for name in ("article", "main"):
            found = found or cut(lambda p, tags: name in tags)
        return found or cut(lambda p, tags: True)

    blocks = [b for b in blocks if b[3]]
    slots = [b for b in blocks if text_token(b[1], b[3]) not in template] if template else blocks
    return "\n\n".join(below(slots, path) or below(blocks, path))


def host_of(url):
    """Host of a url in lower case; empty for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def token_counts(pages, url="url", html="html"):
    """Rows (host, path, token, page, n, chars, every) of the different pages of every host.

    ``token`` is 0 for a container and a digest for a text. A text's number on the page stands with the
    first path that holds it, ``n`` is 0 for the others; ``chars`` counts its characters by path, without
    marked ones, and ``every`` with those that only class words mark.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(F.lit(1), html).alias("page"), F.col(html).alias("html"))
    schema = extend(rows.select("host").schema, "path string, token long, page long, n long, chars long, every long")

    def run(batches):
        for lot, texts in lots(batches, "html", 1 << 20):
            out, seen = [], set()
            for host, page, text in zip(lot.column("host").to_pylist(), lot.column("page").to_pylist(), texts):
                if not text or (host, page) in seen:
                    continue
                seen.add((host, page))
                found, first, boxes = {}, {}, Counter([""])
                for path, tags, mark, block in walk(text):
                    name = "/".join(path)
                    if block is None:
                        boxes[name] += 1
                        continue
                    token = text_token(tags, block)
                    size = found.setdefault((name, token), [0, 0, 0])
                    found[first.setdefault(token, (name, token))][0] += 1
                    size[1] += 0 if mark else len(block)
                    size[2] += 0 if DROPPED.intersection(tags) else len(block)
                out += [(host, name, 0, page, n, 0, 0) for name, n in boxes.items()]
                out += [(host, *key, page, *size) for key, size in found.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), *[pa.int64()] * 5))], names=schema.names)

    # copies of a page that came in other lots
    return rows.mapInArrow(run, schema).groupBy("host", "path", "token", "page").agg(*[F.max(c).alias(c) for c in ("n", "chars", "every")])


def classes(counted, support=SUPPORT):
    """The tokens of all valid classes (host, path, token, vector; no path for texts), slot text by path (host, path, chars, every), and all unmarked text (host, unmarked)."""
    here = F.col("n") > 0
    tokens = settle(counted.groupBy("host", "path", "token").agg(
        F.count(F.when(here, 1)).alias("pages"), F.bit_xor(F.when(here, F.xxhash64("page", "n"))).alias("vector"),
        F.sum("chars").alias("chars"), F.sum("every").alias("every")))
    boxes = tokens.filter("token = 0").select("host", "path", "token", "pages", "vector")
    texts = tokens.filter("token != 0").groupBy("host", F.lit(None).cast("string").alias("path"), "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"))
    often = settle(boxes.unionByName(texts).filter("pages > 1"))
    hosts = boxes.filter("path = ''").select("host", F.col("pages").alias("host_pages"))
    formed = often.groupBy("host", "vector").agg(F.min("pages").alias("pages")).join(hosts, "host").filter(F.col("pages") > support * F.col("host_pages"))
    valid = settle(often.join(formed.select("host", "vector"), ["host", "vector"], "left_semi").select("host", "path", "token", "vector"))
    kept = tokens.groupBy("host").agg(F.sum("chars").alias("unmarked"))
    slots = tokens.filter("token != 0").join(valid.filter("token != 0").select("host", "token"), ["host", "token"], "left_anti")
    return valid, slots.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("every").alias("every")), settle(kept)


def templates(counted, support=SUPPORT):
    """One row per host with a template: ``classes`` (valid ones), ``texts`` (its text tokens), ``main`` (path of the article's slot, or null)."""
    valid, slots, kept = classes(counted, support)
    above = F.expr("CASE WHEN path = '' THEN array('') ELSE transform(sequence(0, size(split(path, '/'))), d -> array_join(slice(split(path, '/'), 1, d), '/')) END")
    held = slots.select("host", F.explode(above).alias("path"), "chars", "every").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("every").alias("every"))
    held = settle(held.join(valid.filter("token = 0").select("host", "path"), ["host", "path"], "left_semi"))
    whole = held.filter("path = ''").select("host", F.col("chars").alias("_chars"), F.col("every").alias("_every"))
    # where class words put off nine tenths of the slot text, and more than all other text, they don't count
    trusted = (10 * F.col("_chars") > F.col("_every")) | (F.col("unmarked") >= F.col("_every") - F.col("_chars"))
    held = held.join(whole, "host").join(kept, "host").select("host", "path", F.when(trusted, F.col("chars")).otherwise(F.col("every")).alias("chars"),
                                           F.when(trusted, F.col("_chars")).otherwise(F.col("_every")).alias("total"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    tag = F.regexp_extract("path", r"([a-z0-9:-]*)[^/]*$", 1)
    most = 2 * F.col("chars") > F.col("total")
    pick = lambda cond, by: F.max_by(F.when(cond, F.struct(depth.alias("depth"), "path")), F.when(cond, by))
    found = held.groupBy("host").agg(
        pick(most & (tag == "article"), -depth).alias("article"), pick(most & (tag == "main"), -depth).alias("named"),
        pick((F.col("total") > 0) & (10 * F.col("chars") >= 9 * F.col("total")), depth).alias("deep"))
    path = F.coalesce("article.path", F.when(F.col("named.depth") > F.coalesce("deep.depth", F.lit(0)), F.col("named.path")), "deep.path")
    found = found.select("host", F.nullif(path, F.lit("")).alias("main"))
    tokens = valid.groupBy("host").agg(F.countDistinct("vector").alias("classes"), F.collect_list(F.when(F.col("token") != 0, F.col("token"))).alias("texts"))
    return settle(tokens.join(found, "host", "left"))


def extract(pages, page="page_id", url="url", html="html", support=SUPPORT):
    """``page``, ``url``, ``text`` and the ``main`` path used, for every row."""
    small_batches(pages)
    found = templates(token_counts(pages, url, html), support)
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(found.select("host", "main", "texts"), "host", "left").select("page_id", "url", "main", "texts", "html")
    schema = extend(rows.drop("html", "texts").schema, "text string")

    def run(batches):
        for lot, texts in lots(batches, "html", 1 << 20):
            out = [main_text(walk(t), tuple(m.split("/")) if m else (), frozenset(x or ())) if t else ""
                   for t, m, x in zip(texts, lot.column("main").to_pylist(), lot.column("texts").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[lot.column(n) for n in ("page_id", "url", "main")], pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


@query("op1_page_templates")
def op1_page_templates(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("main").alias("main_path"))
