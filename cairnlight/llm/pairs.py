"""Broken prompt and response pairs (problem 3)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.operators.ranking import hash_rank
from cairnlight.session import spread, written

WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
FENCE = re.compile(r"^```\w*[ \t]*\r?\n?|\r?\n?```\s*$")
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?')
LABEL = re.compile(r"^[#*>\s-]*([^\n:]{1,40}?)[:*\s]*$")
LISTED = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
TOKEN = re.compile(r"#|[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\s\w]")
NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
BREAK = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+")
TOKEN_OR_BREAK = re.compile(r"\n|" + TOKEN.pattern)
TAIL = re.compile(r"[ \t.!?:;\"*]+(?=\n|$)")

# The labelled sample of answers the kinds of answers are fitted from, besides the answers with a list and the labelled documents.
DECLINED = (
    "I am sorry, but I cannot help with this request.", "As a language model I am not able to give medical advice.", "I must decline to answer that.", "This is outside what I may do.",
    "I would rather not comment on this.", "Regrettably no answer can be given here.", "It is against my rules to judge this.", "I refuse to make a diagnosis; please speak to a professional.",
    "We do not provide this kind of information.", "I won't do that, it would not be safe.", "My apologies, this task is not one I can take on.", "That is not for me to decide, ask your own doctor instead.",
    "I don't feel able to offer an opinion about anyone's health.", "You should turn to somebody qualified for this question.",
    "Lo siento, no puedo ayudar con esta solicitud.", "Prefiero no responder a esta pregunta.", "No me está permitido dar consejos médicos.",
    "Es tut mir leid, dabei kann ich nicht helfen.", "Das darf ich leider nicht beantworten.", "Ich möchte mich dazu nicht äußern.",
    "Je suis désolé, je ne peux pas répondre à cette question.", "Il ne m'est pas permis de donner un avis médical.",
    "Lamento, não posso ajudar com este pedido.", "Não me é permitido responder a isso.", "К сожалению, я не могу ответить на этот вопрос.", "Мне нельзя давать медицинские советы.",
    "Λυπάμαι, δεν μπορώ να απαντήσω σε αυτό.", "Δεν μου επιτρέπεται να δώσω ιατρικές συμβουλές.", "Mi dispiace, non posso rispondere a questa domanda.", "Het spijt me, daar kan ik niet bij helpen.",
)
NOTHING_SAID = ("none", "null", "n/a", "not applicable", "not available", "no answer", "no output", "no response", "unknown", "undefined", "empty", "to be done", "no content", "ninguno", "keine Angabe", "néant", "nenhum", "нет", "κανένα")
# Kinds of answers without a list.
KINDS = ("answer", "declined", "nothing")

#: Slots of the hashed word features of the kinds of answers.
FEATURES = 1 << 15
#: Buckets of the hashed n-gram tables; their size is fixed, so they may be broadcast.
GRAMS = 1 << 15
#: Least number of sightings for a context of the end-of-text model to be trusted.
SEEN = 4


def flat_strings(value: object, out: list[str]) -> list[str]:
    """All strings of a parsed JSON value, in order."""
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            flat_strings(v, out)
    elif isinstance(value, list):
        for v in value:
            flat_strings(v, out)
    return out


def _planned(value: object) -> bool:
    """Whether a parsed answer has a prediction with a plan."""
    rows = value.get("predictions", value) if isinstance(value, dict) else value
    rows = list(rows.values()) if isinstance(rows, dict) else rows
    return isinstance(rows, list) and any(isinstance(x, dict) and bool(x.get("plan")) for x in rows)


def _open_brackets(text: str) -> bool:
    """Whether a JSON text ends inside a string, an array or an object."""
    depth, inside, skip = 0, False, False
    for ch in text:
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
    return inside or depth > 0


class Answer:
    """An answer taken apart: kind (none, json, broken or text), its segments, whether it is listed and whether it is cut."""

    def __init__(self, raw: str | None):
        self.segments: list[str] = []
        self.listed = self.cut = False
        text = (raw or "").strip()
        if text.startswith("```"):
            closed = len(text) > 5 and text.endswith("```")
            text, self.cut = FENCE.sub("", text).strip(), not closed
        if text[:1] in ("{", "[") and text:
            try:
                value = json.loads(text)
                self.kind, self.segments, self.listed = "json", flat_strings(value, []), _planned(value)
            except (ValueError, RecursionError):
                self.kind, self.segments = "broken", [m for m in STRING.findall(text) if m not in ("predictions", "condition", "plan", "text", "kind")]
                self.listed, self.cut = len(self.segments) > 3, self.cut or _open_brackets(text)
        else:
            self.kind = "text"
            self.segments = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
            self.listed = sum(bool(LISTED.match(x)) for x in self.segments) >= 2

    def said(self) -> list[str]:
        """What is said once labels of sections are set aside."""
        title = lambda x: self.kind == "text" and LABEL.match(x) and not LISTED.match(x) and (x.rstrip().endswith((":", "*")) or x.lstrip().startswith("#"))
        return [x for x in self.segments if not title(x)]

    def says_nothing(self) -> bool:
        """Too few letters for the shortest statement; whether short words say something is left to the kinds of answers."""
        return sum(len(m) for x in self.said() for m in LETTERS.findall(x)) < 3


def prompt_parts(prompt: object) -> tuple[str, str]:
    """(opening, whole text) of a prompt: a string, a JSON text or an object with user and system messages.

    The opening, which asks the question, is the first paragraph of the user's message.
    """
    if isinstance(prompt, str) and prompt.lstrip()[:1] == "{":
        try:
            prompt = json.loads(prompt)
        except ValueError:
            pass
    if isinstance(prompt, dict):
        user = prompt.get("user")
        user = user if isinstance(user, str) else ""
        whole = "\n".join(flat_strings(prompt, []))
    else:
        user = whole = prompt if isinstance(prompt, str) else ""
    return re.split(r"\r?\n\s*\r?\n", user.strip())[0], whole


def slots(row: dict) -> Iterator[tuple[str, str, object, object]]:
    """(variant, model, prompt, raw answer) of the completed slots of a results row."""
    text = row["variants"]
    if not (isinstance(text, str) and text.strip()):
        if row["status"] == "completed":
            yield "", "", row["assessment_plan_prompts"], row["assessment_plan_raw"]
        return
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return
    for variant, held in (value.items() if isinstance(value, dict) else ()):
        plans = held.get("assessment_plans") if isinstance(held, dict) else None
        for model, slot in (plans.items() if isinstance(plans, dict) else ()):
            if isinstance(slot, dict) and slot.get("status") == "completed":
                yield variant, model, held.get("assessment_plan_prompts"), slot.get("assessment_plan_raw")


def triples(text: str) -> set[tuple[str, ...]]:
    w = WORD.findall(text.lower())
    return set(zip(w, w[1:], w[2:]))


def copied_share(prompt: str | set, segments: list[str]) -> float:
    """Share of the answer's distinct runs of three words that stand in the prompt (given as text or as its runs)."""
    own = triples(" ".join(segments))
    return len(own & (triples(prompt) if isinstance(prompt, str) else prompt)) / len(own) if own else 0.0


# Language by naive Bayes over character n-grams within words.


def gram_slots(word: str) -> list[int]:
    padded = f" {word} "
    return [
        xxhash.xxh32_intdigest(padded[i : i + n]) % GRAMS for n in (1, 2, 3) for i in range(len(padded) - n + 1)
    ]


class Languages:
    """Naive Bayes over character 1- to 3-grams; each word is scored once and kept as a row of a table."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.array([counts[x] for x in self.names]) if counts else np.zeros((0, GRAMS))
        smooth = 2e-5 * table.sum(axis=1, keepdims=True) + 1e-3
        self.table = np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + GRAMS * smooth))
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.scores = np.zeros((1024, len(self.names)))

    def _row(self, word: str) -> int:
        row = self.rows[word] = len(self.rows)
        if row >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[row] = self.table[:, gram_slots(word)].sum(axis=1)
        return row

    def segment_posteriors(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each language for each segment, its number of letters); n-grams overlap, so the likelihood is tempered by a third."""
        if len(self.rows) > 300_000:
            self._reset()
        found = [LETTERS.findall(x.lower()) for x in segments]
        rows = self.rows
        at = np.array([0, *(rows[w] if w in rows else self._row(w) for f in found for w in f)])
        ends = np.cumsum([0, *map(len, found)])
        sums = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self.scores[at[1:]], axis=0)])
        total = sums[ends[1:]] - sums[ends[:-1]]
        p = np.exp((total - total.max(axis=1, initial=-1e300, keepdims=True)) / 3)
        return p / p.sum(axis=1, keepdims=True), np.array([sum(map(len, f)) for f in found])

    def posterior(self, text: str) -> np.ndarray:
        return self.segment_posteriors([text])[0][0]

    def of_segments(self, segments: list[str]) -> np.ndarray:
        """Posteriors of the segments averaged by their letters, so that a quoted sentence doesn't outweigh the rest."""
        p, letters = self.segment_posteriors(segments)
        return (p * letters[:, None]).sum(axis=0) / max(1, letters.sum())


# Kinds of answers by naive Bayes over words and pairs of words.


def word_features(segments: list[str]) -> Counter:
    """Words, their first four letters and pairs of neighbouring words of the segments."""
    said = Counter(tuple(LETTERS.findall(x.lower())) for x in segments)  # texts repeat themselves: each is taken apart once
    words: Counter = Counter()
    out: Counter = Counter()
    for w, n in said.items():
        for y in w:
            words[y] += n
        for a, b in zip(w, w[1:]):
            out[a + " " + b] += n
    for y, n in words.items():
        out[y] += n
        out["^" + y[:4]] += n
    return out


@lru_cache(1 << 17)
def feature_slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % FEATURES


def feature_table(features: Counter, weight: float = 1.0) -> np.ndarray:
    table = np.zeros(FEATURES)
    for f, n in features.items():
        table[feature_slot(f)] += weight * n
    return table


class Kinds:
    """Naive Bayes of what an answer without a list is: an answer, declined or nothing. Tables are scaled to one total, so a word that no kind has decides nothing."""

    def __init__(self, tables: dict[str, np.ndarray]):
        table = np.array([tables[k] / max(1.0, tables[k].sum()) for k in KINDS])
        self.table = np.log(table + 1e-5)

    def posterior(self, segments: list[str]) -> np.ndarray:
        """Posterior of the kinds; a word has three features, so the likelihood is tempered by a third."""
        features = word_features(segments)
        if not features:
            return np.array([0.0, 0.0, 1.0])
        at = np.fromiter(map(feature_slot, features), dtype=np.int64)
        total = (self.table[:, at] * np.fromiter(features.values(), dtype=float)).sum(axis=1) / 3
        p = np.exp(total - total.max())
        return p / p.sum()


def seeded_kinds(answers: np.ndarray, more: dict[str, np.ndarray] | None = None) -> Kinds:
    """Kinds from the counts of answers, the labelled sample, and soft counts of the answers without a list, which weigh as much as the sample."""
    tables = {"answer": answers, "declined": feature_table(word_features(list(DECLINED))), "nothing": feature_table(word_features(list(NOTHING_SAID)))}
    for kind, table in (more or {}).items():
        if kind != "answer" and table.sum() > 0:
            tables[kind] = tables[kind] / tables[kind].sum() + table / max(table.sum(), tables[kind].sum())
    return Kinds(tables)


# End of text by word n-grams.


@lru_cache(1 << 17)
def token_number(token: str) -> int:
    return xxhash.xxh64_intdigest(token) | 1


LINE_END = np.uint64(token_number("\n"))


def end_contexts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the contexts of the place after every token of the sentences in parts, and the rows of the sentences' ends.

    A row has five contexts, the longest first: the sentence's first two tokens with the last three, the last
    three, the first two with the last two, the last two, the last. Numbers are one token; full stops and
    the like at a sentence's end are set aside. Sentences without a token are left out.
    """
    text = NUMBER.sub("#", BREAK.sub("\n", "\n".join(parts)).lower())
    ids = np.fromiter(map(token_number, TOKEN_OR_BREAK.findall(TAIL.sub("", text) + "\n")), dtype=np.uint64)
    stops = np.flatnonzero(ids == LINE_END)
    length = np.diff(stops, prepend=-1) - 1
    ids, length = ids[ids != LINE_END], length[length > 0]
    if not len(ids):
        return np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.cumsum(length)
    start = np.repeat(ends - length, length)
    place = np.arange(len(ids)) - start
    before = lambda k: np.where(place >= k, ids[np.maximum(np.arange(len(ids)) - k, 0)], np.uint64(0))
    second = np.where(np.repeat(length, length) > 1, ids[np.minimum(start + 1, len(ids) - 1)], np.uint64(0))
    m1, m2, m3, m4, m5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    one, two, three = ids * m1, before(1) * m2, before(2) * m3
    head = ids[start] * m4 + second * m5
    keys = [one + two + three + head + np.uint64(11), one + two + three + np.uint64(7), one + two + head + np.uint64(5), one + two + np.uint64(3), one + np.uint64(1)]
    return np.stack([k.view(np.int64) for k in keys], axis=1), ends - 1


def line_class(line: str) -> str:
    if LISTED.match(line):
        return "number" if line.lstrip()[:1].isdigit() else "bullet"
    return "title" if line.rstrip().endswith((":", "**")) or line.lstrip().startswith("#") else "other"


LINE_CLASSES = ("number", "bullet", "title", "other")


def last_segment(lines: list[str]) -> str:
    return BREAK.split(lines[-1].strip())[-1] if lines else ""


def ending_keys(lines: list[str]) -> list[int] | None:
    """The context keys of the end of an answer's last segment; None where it has no token."""
    contexts, ends = end_contexts([last_segment(lines)])
    return contexts[ends[0]].tolist() if len(ends) else None


def counted_contexts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, seen, ends): how often each context stands in lines, and how often an end follows it."""
    contexts, ends = end_contexts(lines)
    key, at = np.unique(contexts.ravel(), return_inverse=True)
    last = np.bincount(at.reshape(contexts.shape)[ends].ravel(), minlength=len(key))
    return key, np.bincount(at.ravel(), minlength=len(key)), last


def cut_short(lines: list[str], classes: dict[str, tuple[int, int]], known: list[tuple[int, int]] | None, least: float = 0.04, least_line: float = 0.02) -> bool:
    """Whether the end of a text is unlikely: of its last segment's longest known context, or of its last line's class.

    classes: (seen, ends) by class of line; known: (seen, ends) of the last segment's contexts, the longest first, or None where it has no token.
    """
    if not lines:
        return False
    if len(lines) > 1:
        seen, ends = classes.get(line_class(lines[-1]), (0, 0))
        if seen >= SEEN and ends < least_line * seen:
            return True
    if known is None:
        return False
    for seen, ends in known:
        # The answer's own end was counted as well and says nothing about itself.
        if seen - 1 >= SEEN:
            return ends - 1 < least * (seen - 1)
    # No context is known: a full stop after a word is all the evidence there is.
    return not re.search(r"[^\W\d_][.!?]['\")\]]?$", last_segment(lines))


# On Spark.

SLOT_SCHEMA = "result_id bigint, variant string, model string, kind string, verdict string, listed boolean, copied double, opening string, prompt string, lines array<string>, ending array<bigint>"


def analysed_slots(results: DataFrame) -> DataFrame:
    """One row per completed slot: what can be said without statistics (empty, copied, cut), whether there is a list, the copied share, the prompt's opening, the prompt
    (at its first slot in the row only), the answer's lines and the context keys of its end (where they decide)."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SLOT_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                known: dict[str, set] = {}
                for variant, model, prompt, raw in slots(row):
                    if raw is not None and not isinstance(raw, str):
                        raw = json.dumps(raw, ensure_ascii=False)
                    a = Answer(raw)
                    opening, whole = prompt_parts(prompt)
                    new = whole not in known
                    if new:
                        known[whole] = triples(whole)
                    share = copied_share(known[whole], a.segments)
                    verdict = "empty" if a.says_nothing() else "copied" if share >= 0.5 else "cut" if a.cut else ""
                    ending = ending_keys(a.segments) if verdict == "" and a.segments else None
                    rows.append((row["result_id"], variant, model, a.kind, verdict, a.listed, share, opening, whole if new else None, a.segments, ending))
            yield pd.DataFrame(rows, columns=names)

    wanted = results.select("result_id", "status", "assessment_plan_prompts", "assessment_plan_raw", "variants")
    return spread(wanted).mapInPandas(parts, SLOT_SCHEMA)


def _counted(df: DataFrame, fill) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over all rows of hashed counts: fill(batch, {name: array}) adds to them; the tables have a fixed number of slots."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            fill(batch, held)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"name": name, "slot": at, "n": counts[at]})

    sums = df.mapInPandas(parts, "name string, slot int, n double").groupBy("name", "slot").agg(F.sum("n").alias("n"))
    return {name: (g["slot"].to_numpy(), g["n"].to_numpy()) for name, g in sums.toPandas().groupby("name")}


def language_counts(documents: DataFrame, per_language: int = 200, most: int = 4000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(n-gram counts by language, word features) from at most per_language labelled documents each (of 1 to most characters, chosen by hash).

    This is the bounded sample of labelled rows the classifier starts from; languages with fewer than 10 documents are left out.
    """
    usable = documents.filter("trim(lang) <> '' and lang <> 'und' and text is not null").filter(F.char_length("text").between(1, most))
    keyed = usable.select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id"))
    chosen = hash_rank(keyed.drop("_h"), ["lang"], ["doc_id"]).filter(F.col("rank") <= per_language).select("doc_id", "lang")
    texts = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def fill(batch: pd.DataFrame, held: dict[str, np.ndarray]) -> None:
        counted: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            counted.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            held.setdefault(lang, np.zeros(GRAMS + 1))[GRAMS] += 1  # the last slot counts documents
        for lang, words in counted.items():
            add_grams(held[lang], words)
        if len(batch):
            held[""] = held.get("", 0) + feature_table(word_features(batch["text"].tolist()))

    tables, features = {}, np.zeros(FEATURES)
    for lang, (slot, n) in _counted(texts, fill).items():
        table = np.zeros(max(GRAMS + 1, FEATURES))
        table[slot] = n
        if not lang:
            features = table[:FEATURES]
        elif table[GRAMS] >= 10:
            tables[lang] = table[:GRAMS]
    return tables, features


def add_grams(table: np.ndarray, words: Counter) -> None:
    for word, n in words.items():
        np.add.at(table, gram_slots(word), n)


def adapted(base: dict[str, np.ndarray], extra: dict[str, tuple[np.ndarray, np.ndarray]], weight: float = 1.0) -> dict[str, np.ndarray]:
    """Counts of the labelled sample and of the answers it was sure of, each scaled to the same total."""
    out = {}
    for lang, table in base.items():
        out[lang] = table / max(1.0, table.sum())
        if lang in extra:
            slot, n = extra[lang]
            more = np.zeros(GRAMS)
            more[slot] = n
            out[lang] = out[lang] + weight * more / max(1.0, more.sum())
        out[lang] *= 1e5
    return out


def refined_kinds(found: DataFrame, answers: np.ndarray, rounds: int = 2) -> Kinds:
    """Kinds of answers, refined by expectation and maximisation over the answers without a list: each counts for every kind as far as it is likely to be of it."""
    spark = found.sparkSession
    unlisted = found.filter("not listed and verdict in ('', 'cut')").select("lines")
    kinds = seeded_kinds(answers)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(kinds)

        def weigh(batch: pd.DataFrame, out: dict[str, np.ndarray], held: object = held) -> None:
            for lines in batch["lines"]:
                p, features = held.value.posterior(list(lines)), word_features(list(lines))
                for kind, share in zip(KINDS, p):
                    if share > 0.01:
                        out[kind] = out.get(kind, 0) + feature_table(features, share)

        tables = {}
        for kind, (slot, n) in _counted(unlisted, weigh).items():
            tables[kind] = np.zeros(FEATURES)
            tables[kind][slot] = n
        kinds = seeded_kinds(answers, tables)
    return kinds


def defective_pairs(results: DataFrame, documents: DataFrame, rounds: int = 2) -> DataFrame:
    """(result_id, variant, model, defect) for the defective pairs among the completed slots of results.

    documents (doc_id, text, lang) only serves to fit the languages. empty: nothing is said. copied: at least half of the
    answer's runs of three words stand in the prompt. refusal: an answer without a list of findings that is declined by the kinds of answers (seeded_kinds),
    which are fitted on the answers with a list, the labelled documents and a labelled sample, and refined `rounds` times by the answers without a list. language: the
    posterior of the answer's language differs from that of the prompt's opening. truncated: the JSON, or its fence, isn't
    closed, or the end of the text is unlikely for the word n-grams before it. They are tried in this order. Slots without a prompt have no
    language defect and no copies; unreadable rows give no slots; statistics of endings cover all answers.
    """
    found = written(analysed_slots(results))
    base, features = language_counts(documents)
    first = found.sparkSession.sparkContext.broadcast(base)
    columns = ["name", "slot", "n", "ends"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Languages(first.value)
        held: dict[str, np.ndarray] = {}
        seen, ends = Counter(), Counter()
        for batch in batches:
            lines = fill(batch, model, held, seen, ends)
            if lines:
                key, n, last = counted_contexts(lines)
                yield pd.DataFrame({"name": "context", "slot": key, "n": n, "ends": last})
        for name, table in held.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"name": name, "slot": at, "n": table[at].astype(np.int64), "ends": 0})
        yield pd.DataFrame([("line " + x, 0, seen[x], ends[x]) for x in seen], columns=columns)

    def fill(batch: pd.DataFrame, model: Languages, held: dict[str, np.ndarray], seen: Counter, ends: Counter) -> list[str]:
        sure: dict[str, Counter] = {}
        texts: list[str] = []
        judged = [(k, list(x)) for k, v, x in zip(batch["kind"], batch["verdict"], batch["lines"]) if v not in ("empty", "copied") and len(x)]
        listed = [y for v, x in zip(batch["listed"], batch["lines"]) if v for y in x]
        held["answer"] = held.get("answer", 0) + feature_table(word_features(listed))
        for prompt in batch["prompt"]:
            if prompt:
                # The last sentence may be cut by the prompt's own limit.
                texts += BREAK.split(prompt)[:-1]
        posteriors = model.segment_posteriors([" ".join(x) for _, x in judged])[0] if model.names and judged else []
        for p, (_, lines) in zip(posteriors, judged):
            if p.max() > 0.999:
                sure.setdefault(model.names[int(p.argmax())], Counter()).update({w for x in lines for w in LETTERS.findall(x.lower())})
        for kind, lines in judged:
            if kind != "broken":
                texts += lines
            if kind == "text" and len(lines) > 1:
                classes = [line_class(x) for x in lines]
                seen.update(classes)
                ends[classes[-1]] += 1
        for lang, words in sure.items():
            add_grams(held.setdefault("lang " + lang, np.zeros(GRAMS)), words)
        return texts

    counts = written(found.select("kind", "verdict", "listed", "prompt", "lines").mapInPandas(counted, "name string, slot bigint, n bigint, ends bigint"))
    small = counts.filter("name <> 'context'").groupBy("name", "slot").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).toPandas()
    sure = {name[5:]: (g["slot"].to_numpy(), g["n"].to_numpy()) for name, g in small.groupby("name") if name.startswith("lang ")}
    classes = {r.name[5:]: (r.n, r.ends) for r in small.itertuples(index=False) if r.name.startswith("line ")}
    answers = features
    for _, g in small[small["name"] == "answer"].groupby("name"):
        answers = answers / max(1.0, answers.sum()) * g["n"].sum()
        np.add.at(answers, g["slot"].to_numpy(), g["n"].to_numpy())
    fitted = found.sparkSession.sparkContext.broadcast((adapted(base, sure), classes, refined_kinds(found, answers, rounds)))  # tables of fixed size
    slots_ = found.drop("prompt", "copied").withColumn("first", F.col("ending")[0])
    # The longest context has the tokens of all the shorter ones, so its key stands for the five.
    five = slots_.filter("first is not null").groupBy("first").agg(F.first("ending").alias("ending")).select("first", F.posexplode("ending").alias("place", "slot"))
    context = counts.filter("name = 'context'").join(five.select("slot").distinct(), "slot", "left_semi").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    known = five.join(context, "slot").groupBy("first").agg(F.array_sort(F.collect_list(F.struct("place", "n", "ends"))).alias("known"))
    known = known.select("first", F.transform("known", lambda x: x["n"]).alias("seen"), F.transform("known", lambda x: x["ends"]).alias("ends"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, by_class, kinds = Languages(fitted.value[0]), fitted.value[1], fitted.value[2]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                lines = list(r.lines)
                defect = r.verdict
                if defect in ("", "cut") and not r.listed:
                    kind = KINDS[int(kinds.posterior(lines).argmax())]
                    defect = {"declined": "refusal", "nothing": "empty"}.get(kind, defect)
                if defect in ("", "cut"):
                    other = False
                    if len(model.names) > 1 and LETTERS.search(r.opening or "") and any(LETTERS.search(x) for x in lines):
                        asked, given = model.posterior(r.opening), model.of_segments(lines)
                        other = asked.argmax() != given.argmax() and given.max() > 0.5
                    if defect == "cut":
                        defect = "truncated"
                    elif other:
                        defect = "language"
                    elif cut_short(lines, by_class if r.kind == "text" else {}, None if r.seen is None else list(zip(r.seen, r.ends))):
                        defect = "truncated"
                if defect:
                    rows.append((r.result_id, r.variant, r.model, defect))
            yield pd.DataFrame(rows, columns=["result_id", "variant", "model", "defect"])

    return slots_.join(known, "first", "left").drop("first", "ending").mapInPandas(judge, "result_id bigint, variant string, model string, defect string").distinct()
