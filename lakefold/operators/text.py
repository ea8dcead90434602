"""Full-text search over postings: terms, boolean, phrase and NEAR queries, ranking and excerpts.

A postings table has rows (id, col, pos, term). Queries are plans over it: set operations on ids, and
groups of shifted positions. Nothing loops over documents.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType


def tokens(text: Column, kind: str = "unicode", tokenchars: str = "", separators: str = "") -> Column:
    """Array of terms: simple (ASCII letters and digits), unicode (letters and digits, diacritics dropped), porter (unicode, stemmed), trigram.

    tokenchars also belong to words, separators never do (unicode and porter). Null for null.
    """
    if kind == "simple":
        return F.filter(F.split(F.lower(text), r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda t: t != "")
    if kind == "trigram":
        low = F.lower(text)
        return F.when(F.char_length(low) >= 3, F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).when(text.isNotNull(), F.array().cast("array<string>"))
    inside = r"\p{L}\p{N}\p{M}" + _class(tokenchars)
    gap = f"[^{inside}]+" + (f"|[{_class(separators)}]+" if separators else "")
    base, plain = _bases()
    # letters with marks become their base letters, marks of their own go: all in the JVM
    low = F.regexp_replace(F.translate(F.lower(text), base, plain), r"\p{Mn}", "")
    words = F.filter(F.split(low, gap), lambda t: t != "")
    return {"unicode": lambda w: w, "porter": _stemmed}[kind](words)


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


@lru_cache
def _bases() -> tuple[str, str]:
    """Characters that are a letter with marks, and these letters."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(lists: pa.Array) -> pa.Array:
    return _stemmed_lists(lists)


def _stemmed_lists(lists: pa.Array) -> pa.Array:
    """Each different word of a batch is stemmed once; only these become Python objects."""
    words = lists.flatten().dictionary_encode()
    # to_pylist takes ten times as long
    each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    stems = pa.array([None if t is None else (_remembered if len(t) <= LONGEST else stem)(t) for t in each], lists.type.value_type)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=lists.is_null())


def terms_of(text: str, kind: str = "unicode", tokenchars: str = "", separators: str = "") -> list[str]:
    """The terms of a query's text, as tokens() makes them."""
    low = text.lower()
    if kind == "simple":
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)
    if kind == "trigram":
        return [low[k : k + 3] for k in range(len(low) - 2)]
    words = "".join(c if c not in separators and (unicodedata.category(c)[0] in "LNM" or c in tokenchars) else " " for c in low).split(" ")
    words = [w for w in map(fold, words) if w]
    return [stem(w) for w in words] if kind == "porter" else words


def fold(word: str) -> str:
    """Without diacritics."""
    base, plain = _bases()
    return word if word.isascii() else "".join(c for c in word.translate(str.maketrans(base, plain)) if unicodedata.category(c) != "Mn")


def _measure(w: str) -> int:
    return _shape(w).count("vc")


_SHAPES = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxz"})


def _shape(w: str) -> str:
    shape = w.translate(_SHAPES)
    if "y" not in shape:
        return shape
    out = ""
    for i, c in enumerate(shape):
        out += ("v" if i and out[-1] == "c" else "c") if c == "y" else c
    return out


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Fixed values of the published stemming algorithm: suffixes and what they become.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ENDS2, _ENDS3 = tuple(_STEP2), tuple(_STEP3)


def _ending(w: str, ends: tuple[str, ...]) -> str:
    """The longest of the suffixes that w has."""
    return max((e for e in ends if w.endswith(e)), key=len) if w.endswith(ends) else ""


def stem(w: str) -> str:
    """Porter's stemmer for English words in lower case."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")) or _measure(base) == 1 and _cvc(base):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    base = base[:-1]
                w = base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((_STEP2, _ENDS2), (_STEP3, _ENDS3)):
        end = _ending(w, ends)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = _ending(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e"):
        n = _measure(w[:-1])
        w = w[:-1] if n > 1 or n == 1 and not _cvc(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


#: Frequent words' stems stay in the worker; longer words than LONGEST are not remembered.
LONGEST = 32
_remembered = lru_cache(1 << 16)(stem)


def postings(df: DataFrame, id_col: str, text_cols: str | list[str], kind: str = "unicode", only: list[str] | None = None, **options) -> DataFrame:
    """Rows (id, col, pos, term); col numbers the text columns from 0.

    `only` keeps the terms that a query needs (a last * means all that start so), before they are exploded:
    a query over a large table reads its texts but shuffles its own words. Ids repeated across rows are one document.
    """
    cols = [text_cols] if isinstance(text_cols, str) else text_cols
    out = []
    for k, c in enumerate(cols):
        rows = F.transform(tokens(F.col(c), kind, **options), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
        if only is not None:
            whole, starts = [t for t in only if not t.endswith("*")], [t[:-1] for t in only if t.endswith("*")]
            rows = F.filter(rows, lambda r: reduce(lambda a, b: a | b, [r["term"].startswith(t) for t in starts], r["term"].isin(whole)))  # noqa: B023
        out.append(df.select(F.col(id_col).alias("id"), F.lit(k).alias("col"), F.explode(rows).alias("t")).select("id", "col", "t.pos", "t.term"))
    return reduce(DataFrame.unionByName, out)


def term(post: DataFrame, word: str) -> DataFrame:
    return post.where(F.col("term") == word).select("id").distinct()


def prefix(post: DataFrame, start: str) -> DataFrame:
    return post.where(F.col("term").startswith(start)).select("id").distinct()


def phrase(post: DataFrame, words: list[str], last_is_prefix: bool = False) -> DataFrame:
    """Ids with the words at consecutive positions: one pass over the words' postings, grouped by (id, pos - offset)."""
    return _phrase_at(post, words, last_is_prefix).select("id").distinct()


def _phrase_at(post: DataFrame, words: list[str], last_is_prefix: bool = False) -> DataFrame:
    """Where the words stand one after another: (id, col, pos). No words stand nowhere."""
    if not words:
        return post.where("false").select("id", "col", "pos")
    if last_is_prefix:
        post = post.withColumn("term", F.when(F.col("term").startswith(words[-1]) & ~F.col("term").isin(words[:-1]), words[-1]).otherwise(F.col("term")))
    if len(words) == 1:
        return post.where(F.col("term") == words[0]).select("id", "col", "pos")
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(words)])
    hits = post.where(F.col("term").isin(words)).select("id", "col", "pos", F.explode(F.filter(places, lambda p: p["w"] == F.col("term"))).alias("p"))
    return hits.groupBy("id", "col", (F.col("pos") - F.col("p.k")).alias("pos")).agg(F.countDistinct("p.k").alias("n")).where(F.col("n") == len(words)).select("id", "col", "pos")


def near(post: DataFrame, phrases: list[list[str]], distance: int = 10) -> DataFrame:
    """Ids with all phrases in one column, at most `distance` terms between the end of the first and the start of the last.

    Each occurrence looks back at the last one of each phrase, so nothing is paired.
    """
    every = list(dict.fromkeys(map(tuple, phrases)))
    hits = reduce(DataFrame.unionByName, [_phrase_at(post, list(p)).withColumn("p", F.lit(k)) for k, p in enumerate(every)])
    w = Window.partitionBy("id", "col").orderBy("pos", "p")
    back = [F.last(F.when(F.col("p") == k, F.struct("pos", (F.col("pos") + len(p)).alias("end"))), True).over(w) for k, p in enumerate(every)]
    hits = hits.select("id", "pos", *[b.alias(f"b{k}") for k, b in enumerate(back)])
    whole = reduce(lambda a, b: a & b, [F.col(f"b{k}").isNotNull() for k in range(len(every))])
    first = F.least(*[F.col(f"b{k}") for k in range(len(every))]) if len(every) > 1 else F.col("b0")
    return hits.where(whole & (F.col("pos") - first["end"] <= distance)).select("id").distinct()


_QUERY = re.compile(r'NEAR\((?:"[^"]*"|[^)"])*\)|"[^"]*"|[()+:{}^]|-(?=\s*[\w{])|[^\s()":{}+^]+')


class _Question:
    """A query over one postings table: word, prefix*, "a phrase", a + b, col: and {c d}: filters, NEAR(a "b c", n), AND, OR, NOT, parentheses."""

    def __init__(self, text: str, kind: str, columns: list[str], **options):
        self.parts, self.at, self.kind, self.columns, self.options, self.words = _QUERY.findall(text), 0, kind, columns, options, []
        self.plan = self.either()
        if self.at < len(self.parts):
            raise ValueError(f"can't read the query from {self.parts[self.at]!r}")

    def see(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def take(self) -> str:
        self.at += 1
        return self.parts[self.at - 1] if self.at <= len(self.parts) else ""

    # OR binds least, then AND, then NOT, then words side by side
    def either(self):
        out = self.both()
        while self.see() == "OR":
            self.take()
            out = (lambda a, b: lambda post: a(post).union(b(post)).distinct())(out, self.both())
        return out

    def both(self):
        out = self.unless()
        while self.see() == "AND":
            self.take()
            out = self.joined(out, self.unless(), "left_semi")
        return out

    def unless(self):
        out = self.beside()
        while self.see() == "NOT":
            self.take()
            out = self.joined(out, self.beside(), "left_anti")
        return out

    def beside(self):
        out = self.atom()
        while self.see() not in ("", "OR", "AND", "NOT", ")"):
            out = self.joined(out, self.atom(), "left_semi")
        return out

    @staticmethod
    def joined(a, b, how: str):
        return lambda post: a(post).join(b(post), "id", how)

    def of(self, text: str) -> list[str]:
        return terms_of(text, self.kind, **self.options)

    def phrase_words(self) -> tuple[list[str], bool]:
        """Words of `a "b c" + d*`, and whether the last is a prefix."""
        words, star = [], False
        while True:
            head = self.take()
            body = head[1:-1] if head.startswith('"') else head.rstrip("*")
            words += self.of(body)
            star = not head.startswith('"') and head.endswith("*")
            if self.see() == "*":
                self.take()
                star = True
            if self.see() != "+":
                return words, star
            self.take()

    def wanted(self) -> list[int] | None:
        """Column numbers of a filter, if one stands here."""
        start, negated = self.at, False
        if self.see() == "-":
            self.take()
            negated = True
        names = []
        if self.see() == "{":
            self.take()
            while self.see() not in ("}", ""):
                names.append(self.take())
            self.take()
        elif self.at + 1 < len(self.parts) and self.parts[self.at + 1] == ":":
            names.append(self.take())
        if not names or self.see() != ":":
            self.at = start
            return None
        self.take()
        lower = [c.lower() for c in self.columns]
        unknown = [n for n in names if n.strip('"').lower() not in lower]
        if unknown:
            raise ValueError(f"no such column: {unknown[0]}")
        found = [lower.index(n.strip('"').lower()) for n in names]
        return [k for k in range(len(lower)) if k not in found] if negated else found

    def atom(self):
        only = self.wanted()
        if only is not None:
            inner = self.atom()
            return lambda post: inner(post.where(F.col("col").isin(only)))
        head = self.see()
        if head in ("", ")", "AND", "OR", "NOT"):
            raise ValueError("the query ends too early" if not head else f"can't read the query from {head!r}")
        if head == "(":
            self.take()
            inner = self.either()
            if self.take() != ")":
                raise ValueError("a parenthesis is open")
            return inner
        if head == "^":
            self.take()
            words, star = self.phrase_words()
            self.words += words[:-1] + [words[-1] + "*" * star] if words else []
            return lambda post: _phrase_at(post, words, star).where("pos = 0").select("id").distinct()
        if head.startswith("NEAR("):
            body, _, n = self.take()[5:-1].rpartition(",")
            if not body or not n.strip().isdigit():
                body, n = head[5:-1], "10"
            phrases = [p for p in (self.of(x.strip('"')) for x in re.findall(r'"[^"]*"|[^\s"]+', body)) if p]
            self.words += [w for p in phrases for w in p]
            return lambda post: near(post, phrases, int(n)) if phrases else post.where("false").select("id")
        words, star = self.phrase_words()
        self.words += words[:-1] + [words[-1] + "*" * star] if words else []
        if len(words) == 1:
            return lambda post: prefix(post, words[0]) if star else term(post, words[0])
        return lambda post: phrase(post, words, star)


def search(post: DataFrame, query: str, kind: str = "unicode", columns: list[str] | None = None, **options) -> DataFrame:
    """Ids that match a query (see _Question); its words go through the tokenizer that made the postings."""
    return _Question(query, kind, columns or [], **options).plan(post)


def search_texts(df: DataFrame, id_col: str, text_cols: str | list[str], query: str, kind: str = "unicode", **options) -> DataFrame:
    """search() over texts: only the query's words become postings."""
    cols = [text_cols] if isinstance(text_cols, str) else text_cols
    asked = _Question(query, kind, cols, **options)
    return asked.plan(postings(df, id_col, cols, kind, asked.words, **options))


def bm25(post: DataFrame, words: list[str], k1: float = 1.2, b: float = 0.75, weights: list[float] | None = None) -> DataFrame:
    """Rows (id, score) of documents with any of the words; the best have the least (most negative) score.

    Hits in column k count weights[k] times (1 by default). Lengths and hits are counted in one pass, so
    a row per document is shuffled, not one per word.
    """
    words = list(dict.fromkeys(words))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("col") + 1) if weights else F.lit(1.0)
    hits = [F.sum(F.when(F.col("term") == w, weight)).alias(f"tf{k}") for k, w in enumerate(words)]
    docs = post.groupBy("id").agg(F.count("*").alias("len"), *hits)
    stats = docs.agg(F.count("*").alias("docs"), F.avg("len").alias("avg"), *[F.count(f"tf{k}").alias(f"df{k}") for k in range(len(words))])
    # stats has one row
    rows = docs.where(F.coalesce(*[F.col(f"tf{k}") for k in range(len(words))]).isNotNull()).crossJoin(F.broadcast(stats))

    def part(k: int) -> Column:
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.ln((F.col("docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return F.coalesce(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg"))), F.lit(0.0))

    return rows.select("id", (-reduce(lambda x, y: x + y, [part(k) for k in range(len(words))])).alias("score"))


def vocabulary(post: DataFrame, detail: str = "row") -> DataFrame:
    """row: (term, doc, cnt); col: the same per column; instance: (term, id, col, pos)."""
    if detail == "instance":
        return post.select("term", "id", "col", "pos")
    by = ["term", "col"] if detail == "col" else ["term"]
    # documents first, so that a frequent term's documents are counted, not gathered
    return post.groupBy(*by, "id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


def highlight(text: Column, words: list[str], before: str = "[", after: str = "]") -> Column:
    """text with each of the words, in any case, between marks."""
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, before.replace("\\", "\\\\").replace("$", "\\$") + "$1" + after.replace("\\", "\\\\").replace("$", "\\$"))


def snippet(text: Column, words: list[str], size: int = 16, before: str = "[", after: str = "]", gap: str = "...") -> Column:
    """The window of `size` words with most different query words, the earliest of equal ones, marked.

    All in the JVM. One look at each word: of every query word only its last place is kept.
    """
    wanted = list(dict.fromkeys(words))
    word, rest = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]*"
    hit = lambda w: F.lower(w).isin(wanted)
    mark = lambda w: F.when(hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w)

    def best(found: Column) -> Column:
        """Number of the last word of the best window, from the places of query words."""
        start = F.struct(*[F.lit(-size).alias(f"at{k}") for k in range(len(wanted))], F.lit(0).alias("most"), F.lit(0).alias("end"))

        def step(state: Column, x: Column) -> Column:
            at = [F.when(x["word"] == w, x["i"]).otherwise(state[f"at{k}"]) for k, w in enumerate(wanted)]
            n = reduce(lambda a, b: a + b, [(p > x["i"] - size).cast("int") for p in at], F.lit(0))
            return _let(F.struct(*[p.alias(f"at{k}") for k, p in enumerate(at)], n.alias("n")), lambda s: F.struct(*[s[f"at{k}"].alias(f"at{k}") for k in range(len(wanted))], F.greatest(state["most"], s["n"]).alias("most"), F.when(s["n"] > state["most"], x["i"]).otherwise(state["end"]).alias("end")))

        return F.aggregate(found, start, step)["end"]

    def cut(d: Column) -> Column:
        """From all words, and all words with what follows them."""
        found = F.filter(F.transform(d["words"], lambda w, i: F.struct(i.alias("i"), F.lower(w).alias("word"))), lambda x: x["word"].isin(wanted))

        def shown(at: Column) -> Column:
            whole = F.zip_with(F.slice(d["words"], at + 1, size), F.slice(d["units"], at + 1, size), lambda w, u: F.struct(mark(w).alias("w"), F.concat(mark(w), F.substring(u, F.char_length(w) + 1, F.char_length(u))).alias("u")))
            inside = _let(whole, lambda s: F.concat(F.array_join(F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x["u"]), ""), F.element_at(s, -1)["w"]))
            return F.concat(F.when(at > 0, gap).otherwise(""), inside, F.when(at + size < F.size(d["words"]), gap).otherwise(""))

        return _let(F.greatest(best(found) - size + 1, F.lit(0)), shown)

    parts = F.struct(F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"), F.regexp_extract_all(text, F.lit(word + rest), F.lit(0)).alias("units"))
    return _let(parts, lambda d: F.when(F.size(d["words"]) > 0, cut(d)).otherwise(text))


def _let(x: Column, f) -> Column:
    """f of x, which is computed once, whatever f does with it."""
    return F.transform(F.array(x), f)[0]


def offsets(post: DataFrame, words: list[str]) -> DataFrame:
    """Rows (id, col, term, pos) of the query's words."""
    return post.where(F.col("term").isin(words)).select("id", "col", "term", "pos")


def match_info(post: DataFrame, words: list[str]) -> DataFrame:
    """Per document, column and word (the x of matchinfo): hits there, hits in all documents' column, documents with hits in it."""
    here = post.where(F.col("term").isin(words)).groupBy("id", "col", "term").agg(F.count("*").alias("hits"))
    # a row per query word and column
    total = here.groupBy("col", "term").agg(F.sum("hits").alias("all_hits"), F.count("*").alias("docs"))
    return here.join(F.broadcast(total), ["col", "term"]).select("id", "col", "term", "hits", "all_hits", "docs")


def match_stats(post: DataFrame, columns: int = 1) -> DataFrame:
    """The n, a and l of matchinfo: per document its terms in each column (l), beside the number of documents (n) and the columns' mean lengths (a)."""
    lengths = [F.count_if(F.col("col") == k).alias(f"l{k}") for k in range(columns)]
    docs = post.groupBy("id").agg(*lengths)
    # one row
    whole = docs.agg(F.count("*").alias("n"), *[F.avg(f"l{k}").alias(f"a{k}") for k in range(columns)])
    return docs.crossJoin(F.broadcast(whole))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similar_words(words: DataFrame, col: str, target: str, most: int = 2) -> DataFrame:
    """Words within `most` edits of target; the length bound goes first."""
    near_length = F.abs(F.char_length(col) - len(target)) <= most
    return words.where(near_length).withColumn("distance", F.levenshtein(F.col(col), F.lit(target), most)).where("distance >= 0")
