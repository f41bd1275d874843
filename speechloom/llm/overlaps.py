"""Evaluation questions that recur in the training split, by Aho-Corasick automata over shards.

Questions become canonical strings: consistent characters, lower case, no punctuation, and words one slip away
from a common word of the corpus set to it. Evaluation questions (whole, and without a possible opening phrase)
are the passages of an automaton for each shard; all training questions are scanned with it. The matched intervals
are merged into the coverage of the evaluation question and of the training question; they overlap if both are
covered but for opening phrases. A phrase counts as an opening if some question occurs in the same recording
with and without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import Lattice, canonical_text
from speechloom.session import cut

#: Share of all questions that hold a common word; so at most (words of a question) / COMMON words are common.
COMMON = 0.002
#: An opening phrase has no digits and at most this many words.
OPENING_WORDS = 6
#: Share of the words that are not common (names, above all) that hold a usual trigram of theirs.
USUAL = 0.0005

_token = re.compile(r"\d+|[^\W\d_]+")
_delimiter = re.compile(r"[,:;、。…-]")
_dense = re.compile(r"[぀-ヿ㐀-鿿가-힣ー]")


def file_of_path(path: Column) -> Column:
    """The file's name in lower case without folder, extension or query, however the path is spelled."""
    text = F.coalesce(F.try_url_decode(path), path)
    text = F.regexp_replace(text, r"[?#].*$", "")
    name = F.regexp_extract(F.trim(F.regexp_replace(text, r"[\s|]+$", "")), r"([^/\\:]+)$", 1)
    return F.nullif(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")), F.lit(""))


def file_of_recording(rec_id: Column) -> Column:
    return F.lower(F.element_at(F.split(rec_id, "__"), -1))


def tokens(text: str) -> tuple[list[str], int]:
    """Comparable tokens, and how many stand before the first delimiter that is not inside a number (0: none)."""
    low = text.lower()
    out, opening = [], 0
    first = None
    for m in _delimiter.finditer(low):
        inside = m.start() and m.end() < len(low) and low[m.start() - 1].isdigit() and low[m.end()].isdigit()
        if not inside:
            first = m.start()
            break
    for m in _token.finditer(low):
        if first is not None and m.start() < first:
            opening += 1
        out.append(m.group())
    return out, opening


def slips(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and exchanges of neighbours that turn a into b (3: more than two)."""
    if abs(len(a) - len(b)) > 2:
        return 3
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return min(one[-1], 3)


def mistyped(a: str, b: str) -> bool:
    """Whether b is a with a letter left out or doubled or two neighbours exchanged, or a is so made from b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def trigrams(word: str) -> set[str]:
    return {f" {word} "[i : i + 3] for i in range(len(word))}


class Speller:
    """Sets words one slip (two in longer ones) from a common word to it; numbers and other words stay."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.near: dict[str, list[str]] = {}
        for w in common:
            if len(w) > 4:
                for x in {w, *shortened(w), *(z for y in shortened(w) for z in shortened(y) if len(w) > 5)}:
                    self.near.setdefault(x, []).append(w)
        self.known: dict[str, str] = {}

    def _best(self, word: str) -> str:
        parts = {word, *shortened(word)}
        if len(word) > 5:
            parts |= {z for y in shortened(word) for z in shortened(y)}
        found = [(slips(word, c), -self.common[c], c) for c in {c for x in parts for c in self.near.get(x, ())}]
        found = [x for x in found if x[0] <= (2 if len(x[2]) > 5 else 1)]
        return min(found)[2] if found else word

    def __call__(self, word: str) -> str:
        if len(word) < 3 or word in self.common or word.isdigit():
            return word
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._best(word)
        return self.known[word]


def joined(words: list[str]) -> str:
    """Words with a space between, none beside characters of scripts written without."""
    out = ""
    for w in words:
        dense = out and (_dense.match(out[-1]) or _dense.match(w[0]))
        out += w if not out or dense else f" {w}"
    return out


def common_words(questions: DataFrame, text: str) -> tuple[dict[str, int], set[str]]:
    """Words in at least COMMON of all texts with their numbers of texts, and the usual trigrams of the other words.

    Both are counted over the whole table and bounded by the inverse of their least shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        counts: dict[str, int] = {}
        n = 0
        for b in batches:
            for x in b.column(0).to_pylist():
                n += 1
                for w in set(tokens(canonical_text(x, lattice))[0]) if x else ():
                    if not w.isdigit():
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                counts = {}
        yield pa.RecordBatch.from_arrays([pa.array([*counts, ""], pa.string()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    counts = questions.select(F.col(text).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(3, COMMON * total)
    common = {r.word: r.n for r in counts.where((F.col("word") != "") & (F.col("n") >= least)).collect()}
    other = counts.where((F.col("word") != "") & (F.col("n") < least) & (F.length("word") > 2))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    each = other.select("n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3))))).alias("t"))
    tokens_of_others = other.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    usual = {r.t for r in each.groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, USUAL * tokens_of_others)).collect()}
    return common, usual


def comparable(questions: DataFrame, common: dict[str, int], keep: list[str], text: str = "question") -> DataFrame:
    """(keep..., shape, names, opening, rest, tail) of texts that are not null or blank.

    shape: the comparable string with a star for each word that is not common; names: those words; opening: a
    possible opening phrase, and rest: the shape without it; tail: the numbers and the last common word.
    """
    rows = questions.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", shape string, names string, opening string, rest string, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, spell = Lattice(), Speller(common)
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1).to_pylist():
                words, n = tokens(canonical_text(x, lattice))
                words = [spell(w) for w in words]
                usual = [w in common or w.isdigit() for w in words]
                shape = [w if u else "*" for w, u in zip(words, usual)]
                usable = 0 < n < len(words) and n <= OPENING_WORDS and not any(w.isdigit() for w in words[:n])
                last = next((w for w in reversed(words) if w in common), "")
                out.append((joined(shape), " ".join(w for w, u in zip(words, usual) if not u), joined(words[:n]) if usable else None, joined(shape[n:]) if usable else None, " ".join([*(w for w in words if w.isdigit()), last])))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(list(c), pa.string()) for c in columns)], [*b.schema.names[:-1], "shape", "names", "opening", "rest", "tail"])

    return rows.mapInArrow(run, schema).where("shape != ''")


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(usual: set[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard: an automaton of its evaluation passages over its training texts.

        Rows (file, held_out, shape, names, opening, rest), evaluation rows first.
        """
        import ahocorasick

        # passage -> file -> names, whole or with one shortened -> (names, opening)
        passages: dict[str, dict[str, dict[tuple, list[tuple[str, str, str | None]]]]] = {}
        machine = None
        columns = ["file", "eval_shape", "eval_names", "train_shape", "train_names", "eval_opening", "train_opening"]

        def keys(names: list[str]):
            yield (-1, *names)
            for i, name in enumerate(names):
                if len(name) > 3:
                    for x in (name, *shortened(name)):
                        yield (i, *names[:i], x, *names[i + 1 :])

        def same(a: list[str], b: list[str]) -> bool:
            """Equal, but for one name that is mistyped: it or its partner has a trigram that names usually lack."""
            odd = [(x, y) for x, y in zip(a, b) if x != y]
            return not odd or len(odd) == 1 and mistyped(*odd[0]) and not all(trigrams(x) <= usual for x in odd[0])

        for b in batches:
            out: list[tuple] = []
            for file, held_out, shape, names, opening, rest in zip(*(c.to_pylist() for c in b.columns)):
                own = names.split()
                if held_out:
                    for p, lead in ((shape, None), *([(rest, opening)] if opening else [])):
                        n = p.count("*")
                        at = passages.setdefault(p, {}).setdefault(file, {})
                        for k in set(keys(own[len(own) - n :])):
                            at.setdefault(k, []).append((shape, names, lead))
                    continue
                if not passages:
                    continue
                if machine is None:
                    machine = ahocorasick.Automaton()
                    for p in passages:
                        machine.add_word(p, p)
                    machine.make_automaton()
                hits: dict[str, list[tuple[int, int]]] = {}
                for end, p in machine.iter(shape):
                    if file in passages[p]:
                        hits.setdefault(p, []).append((end + 1 - len(p), end + 1))
                for p, intervals in hits.items():
                    a, z = covered(intervals)[-1]
                    # the passage is covered whole; the training text must be too, but for an opening phrase
                    if z < len(shape) or (a > 0 and p != rest):
                        continue
                    n = p.count("*")
                    mine = own[len(own) - n :]
                    seen = set()
                    for k in set(keys(mine)):
                        for other, theirs, lead in passages[p][file].get(k, ()):
                            if (other, theirs, lead) not in seen:
                                seen.add((other, theirs, lead))
                                if same(mine, theirs.split()[len(theirs.split()) - n :]):
                                    out.append((file, other, theirs, shape, names, lead, opening if a > 0 else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], columns)

    return scan


def split_overlaps(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """Pairs of a train row and a dev or test row that ask the same, or almost, about the same recording.

    (eval_no, train_no, split, source), split and source of the evaluation row. Rows whose path is null or names
    no known recording, and null or blank questions, have no pairs. Re-loaded rows count as rows of their own:
    the scan sees each different text of a recording once, whatever its number of copies, and the rows are joined
    to the result. A shard is a hash of the recording, the numbers and the last common word, which a text shares
    with any passage that could match it, so a recording with a third of all rows spreads over the shards too.
    Names must be equal, but that one may be mistyped (a letter left out or doubled, neighbours exchanged).
    """
    known = recordings.select(file_of_recording(F.col("rec_id")).alias("file")).distinct()
    rows = samples.where("sample_no is not null and split is not null").select("sample_no", "split", "source", "question", file_of_path(F.col("audio_path")).alias("file")).where("file is not null")
    common, usual = common_words(samples, "question")
    rows = cut(comparable(rows, common, ["sample_no", "split", "source", "file"]).join(known, "file", "left_semi"))
    held_out = F.col("split") != "train"
    texts = rows.select("file", held_out.alias("held_out"), "shape", "names", "opening", "rest", "tail").distinct()
    sharded = texts.repartition("file", "tail").sortWithinPartitions(F.desc("held_out")).drop("tail")
    found = sharded.mapInArrow(_scanner(usual), "file string, eval_shape string, eval_names string, train_shape string, train_names string, eval_opening string, train_opening string")
    found = cut(found.distinct())
    shown = found.where("(eval_opening is null) != (train_opening is null)").select(F.coalesce("eval_opening", "train_opening").alias("opening")).distinct()
    both = found.where("eval_opening is not null and train_opening is not null")
    both = both.join(shown.withColumnRenamed("opening", "eval_opening"), "eval_opening", "left_semi").join(shown.withColumnRenamed("opening", "train_opening"), "train_opening", "left_semi")
    one = found.where("eval_opening is null or train_opening is null")
    sides = ["file", "eval_shape", "eval_names", "train_shape", "train_names"]
    pairs = one.select(sides).unionByName(both.select(sides)).distinct()
    tests = rows.where(held_out).select("file", F.col("shape").alias("eval_shape"), F.col("names").alias("eval_names"), F.col("sample_no").alias("eval_no"), "split", "source")
    train = rows.where(~held_out).select("file", F.col("shape").alias("train_shape"), F.col("names").alias("train_names"), F.col("sample_no").alias("train_no"))
    return pairs.join(tests, ["file", "eval_shape", "eval_names"]).join(train, ["file", "train_shape", "train_names"]).select("eval_no", "train_no", "split", "source")


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """(split, source, pairs, eval_rows) of the found pairs."""
    per_row = pairs.groupBy("split", "source", "eval_no").agg(F.count("*").alias("n"))
    return per_row.groupBy("split", "source").agg(F.sum("n").alias("pairs"), F.count("*").alias("eval_rows"))
