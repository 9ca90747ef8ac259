"""Tokenizers as plans that compile to columns.

A plan is a chain of wrappers around a base: ids (``IndexedTokenization``), protected patterns
(``MatchTokenization``), normalizers and the splitters. It compiles to nested arrays, sentence by sentence; nothing
leaves the row, so a plan works on streams too and never shuffles. Normalizers outside the match wrapper rewrite
a sentence before patterns are sought; those inside it rewrite gaps only, so protected tokens stay as they are.
An outer normalizer runs before an inner one. Empty texts give no tokens and no ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import matching, normalize, splitters
from lexiloom.functions.codemap import CodeMap
from lexiloom.functions.columns import let, nested
from lexiloom.functions.normalize import PythonText, UnicodeFlags
from lexiloom.plans.nodes import Node
from lexiloom.plans.stages import DOCUMENT, SENTENCE, SUBSENTENCE, TOKEN, WORD, Stage, kind

Splitter = Callable[[Column], Column]


# ---- bases ----


class BaseTokenization(Node):
    """How documents, sentences, sub-sentences and words are split; override what differs."""

    def split_document(self, text: Column) -> Column:
        return splitters.split_sentences(text)

    def split_sentence(self, text: Column) -> Column:
        return splitters.words(text)

    def split_subsentence(self, text: Column) -> Column:
        return splitters.words(text)

    def split_word(self, text: Column) -> Column | None:
        """None: words aren't split, they are tokens."""
        return None

    def splittable(self, stage: str | Stage) -> bool:
        own = kind(stage)
        return own in (DOCUMENT, SENTENCE, SUBSENTENCE) or (own == WORD and self.split_word(F.lit("")) is not None)

    def __repr__(self) -> str:
        return type(self).__name__


@dataclass(frozen=True, repr=False)
class DefaultTokenization(BaseTokenization):
    def __repr__(self) -> str:
        return "default"


def _name(f: Any) -> str:
    return getattr(f, "__name__", repr(f))


@dataclass(frozen=True, repr=False)
class WordTokenization(BaseTokenization):
    """Both splitters given."""

    split_sentences: Splitter = splitters.split_sentences
    tokenize: Splitter = splitters.words

    def split_document(self, text: Column) -> Column:
        return self.split_sentences(text)

    def split_sentence(self, text: Column) -> Column:
        return self.tokenize(text)

    split_subsentence = split_sentence

    def __repr__(self) -> str:
        return f"WordTokenization(split_sentences = {_name(self.split_sentences)}, tokenize = {_name(self.tokenize)})"


@dataclass(frozen=True, repr=False)
class EachSplitTokenization(BaseTokenization):
    """Sentences cut at a delimiter: a text, a pattern, or a list of characters. Documents are cut as by default."""

    splitter: matching.Pattern | tuple[str, ...]

    def split_sentence(self, text: Column) -> Column:
        s = self.splitter
        pattern = "|".join(matching.as_match(c) for c in s) if isinstance(s, (tuple, list)) else matching.as_match(s)
        return matching.each_split(text, pattern)

    def __repr__(self) -> str:
        return f"EachSplitTokenization({self.splitter!r})"


@dataclass(frozen=True, repr=False)
class EachMatchTokenization(BaseTokenization):
    """Tokens are the matches of a pattern in the sentence."""

    pattern: matching.Pattern

    def split_sentence(self, text: Column) -> Column:
        return matching.find_all(text, self.pattern)

    def __repr__(self) -> str:
        return f"EachMatchTokenization({self.pattern!r})"


@dataclass(frozen=True, repr=False)
class MatchSplitsTokenization(BaseTokenization):
    """Tokens are the matches and the gaps between them."""

    patterns: matching.Pattern | tuple[matching.Pattern, ...]

    def split_sentence(self, text: Column) -> Column:
        return F.transform(matching.matchsplits(text, self.patterns), lambda p: p["x"])

    def __repr__(self) -> str:
        return f"MatchSplitsTokenization({self.patterns!r})"


@dataclass(frozen=True, repr=False)
class SubwordTokenization(BaseTokenization):
    """Another base whose words are split further, by characters if nothing else is given."""

    split: Splitter = splitters.characters
    base: BaseTokenization = field(default_factory=DefaultTokenization)

    def split_document(self, text: Column) -> Column:
        return self.base.split_document(text)

    def split_sentence(self, text: Column) -> Column:
        return self.base.split_sentence(text)

    def split_subsentence(self, text: Column) -> Column:
        return self.base.split_subsentence(text)

    def split_word(self, text: Column) -> Column | None:
        return self.split(text)

    def __repr__(self) -> str:
        return f"SubwordTokenization({_name(self.split)}, {self.base!r})"


@dataclass(frozen=True, repr=False)
class MixedTokenization(Node):
    """Several tokenizations by number; a container without splitting of its own."""

    of: tuple[Any, ...]

    def __init__(self, *of: Any):
        object.__setattr__(self, "of", of[0] if len(of) == 1 and isinstance(of[0], tuple) else of)

    def __getitem__(self, k: int) -> Any:
        return self.of[k]

    def __len__(self) -> int:
        return len(self.of)

    def __repr__(self) -> str:
        return f"MixedTokenization({', '.join(map(repr, self.of))})"


# ---- wrappers ----


class WrappedTokenization(Node):
    """A base with something added."""

    base: Any

    def splittable(self, stage: str | Stage) -> bool:
        return self.base.splittable(stage)

    def shown(self) -> list[str]:
        return []

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join([repr(self.base), *self.shown()])})"


def _default():
    return field(default_factory=DefaultTokenization)


@dataclass(frozen=True, repr=False)
class IndexedTokenization(WrappedTokenization):
    """Adds sentence_id, word_id and token_id; the outermost wrapper."""

    base: Any = _default()


@dataclass(frozen=True, repr=False)
class MatchTokenization(WrappedTokenization):
    """Patterns, by priority, whose matches are protected tokens; adds ``ismatch``."""

    base: Any = _default()
    patterns: tuple[matching.Pattern, ...] = ()

    def __init__(self, base: Any = None, patterns: Any = None):
        if patterns is None:
            base, patterns = DefaultTokenization(), base
        if not patterns:
            raise ValueError("MatchTokenization needs patterns")
        object.__setattr__(self, "base", base)
        object.__setattr__(self, "patterns", tuple(patterns))

    def shown(self) -> list[str]:
        return [f"{len(self.patterns)} patterns"]


class SentenceNormalizer(WrappedTokenization):
    """Rewrites sentences and sub-sentences before they are split, and bare words; never tokens."""

    def steps(self) -> list[Callable[[Column], Column]]:
        raise NotImplementedError


class WordNormalizer(WrappedTokenization):
    """Rewrites every word after the split; never tokens."""

    def steps(self) -> list[Callable[[Column], Column]]:
        raise NotImplementedError


@dataclass(frozen=True, repr=False)
class LowercaseNormalizer(SentenceNormalizer):
    base: Any = _default()

    def steps(self):
        return [normalize.lowercase]


@dataclass(frozen=True, repr=False)
class UnicodeNormalizer(SentenceNormalizer):
    """A normal form by its name, or steps by flags."""

    base: Any = _default()
    flags: UnicodeFlags = field(default_factory=UnicodeFlags)

    def __init__(self, base: Any = None, form: str | None = None, flags: UnicodeFlags | None = None, **on: bool):
        if isinstance(base, str):
            base, form = None, base
        if flags is None:
            flags = UnicodeFlags.named(form) if form else UnicodeFlags.of(**on)
        object.__setattr__(self, "base", base or DefaultTokenization())
        object.__setattr__(self, "flags", flags)

    def steps(self):
        return self.flags.steps()

    def shown(self) -> list[str]:
        return [repr(self.flags)]


@dataclass(frozen=True, repr=False)
class SentenceReplaceNormalizer(SentenceNormalizer):
    """``pattern`` replaced in sentences; groups as \\1."""

    pattern: str
    replacement: str
    base: Any = _default()

    def steps(self):
        return [normalize.replaced(self.pattern, self.replacement)]

    def shown(self) -> list[str]:
        return [f"{self.pattern!r} => {self.replacement!r}"]


ReplaceNormalizer = SentenceReplaceNormalizer


@dataclass(frozen=True, repr=False)
class WordReplaceNormalizer(WordNormalizer):
    """``pattern`` replaced in words."""

    pattern: str
    replacement: str
    base: Any = _default()

    def steps(self):
        return [normalize.replaced(self.pattern, self.replacement)]

    def shown(self) -> list[str]:
        return [f"{self.pattern!r} => {self.replacement!r}"]


@dataclass(frozen=True, repr=False)
class SentenceFuncNormalizer(SentenceNormalizer):
    """A function Column -> Column, or a ``PythonText``, on sentences."""

    f: Callable[[Column], Column]
    base: Any = _default()

    def steps(self):
        return [self.f]

    def shown(self) -> list[str]:
        return [_name(self.f)]


@dataclass(frozen=True, repr=False)
class WordFuncNormalizer(WordNormalizer):
    """A function Column -> Column, or a ``PythonText``, on words."""

    f: Callable[[Column], Column]
    base: Any = _default()

    def steps(self):
        return [self.f]

    def shown(self) -> list[str]:
        return [_name(self.f)]


@dataclass(frozen=True, repr=False)
class CodeNormalizer(WordNormalizer):
    """Words through a code map."""

    codemap: CodeMap
    base: Any = _default()

    def steps(self):
        return [self.codemap]

    def shown(self) -> list[str]:
        return [repr(self.codemap)]


# ---- compiling ----


@dataclass
class _Chain:
    """A plan in the order in which it works."""

    indexed: bool = False
    before: list = field(default_factory=list)
    patterns: list = field(default_factory=list)
    inside: list = field(default_factory=list)
    words: list = field(default_factory=list)
    base: Any = None

    @classmethod
    def of(cls, plan: Any) -> _Chain:
        out = cls()
        while isinstance(plan, WrappedTokenization):
            if isinstance(plan, IndexedTokenization):
                if out.patterns or out.before or out.inside or out.words:
                    raise ValueError("IndexedTokenization has to be the outermost wrapper")
                out.indexed = True
            elif isinstance(plan, MatchTokenization):
                if out.inside:
                    raise ValueError("a normalizer between two match wrappers isn't possible")
                out.patterns += plan.patterns
            elif isinstance(plan, SentenceNormalizer):
                (out.inside if out.patterns else out.before).extend(plan.steps())
            elif isinstance(plan, WordNormalizer):
                out.words += plan.steps()
            else:
                raise TypeError(f"unknown wrapper {plan!r}")
            plan = plan.base
        if not isinstance(plan, BaseTokenization):
            raise TypeError(f"{plan!r} has no splitting")
        out.base = plan
        return out

    @property
    def splits_words(self) -> bool:
        return self.base.split_word(F.lit("")) is not None


def _apply(steps: list, texts: Column, depth: int) -> Column:
    for f in steps:
        texts = f(texts, depth) if isinstance(f, PythonText) else nested(f, depth)(texts)
    return texts


def _piece(x: Column, ismatch: bool | Column = False) -> Column:
    return F.struct((F.lit(ismatch) if isinstance(ismatch, bool) else ismatch).alias("ismatch"), x.alias("x"))


def _rewritten(pieces: Column, steps: list, depth: int) -> Column:
    """Steps on the unprotected pieces of nested arrays; those in Python run over the arrays as a whole."""
    for f in steps:
        if isinstance(f, PythonText):
            pieces = f.on_gaps(pieces, depth)
        else:
            pieces = nested(_on_gap(f), depth)(pieces)
    return pieces


def _on_gap(f: Callable[[Column], Column]):
    return lambda p: _piece(F.when(p["ismatch"], p["x"]).otherwise(f(p["x"])), p["ismatch"])


def compiled(plan: Any, stage: str | Stage, text: Column) -> Column:
    """Sentences of words of tokens, three arrays deep; other stages have one sentence. A token is (ismatch, x) where the plan has patterns, else its text."""
    chain, own = _Chain.of(plan), kind(stage)
    return F.when(text.isNotNull(), _split(chain, own, _sentences(chain, own, text)))


def _sentences(chain: _Chain, own: Stage, text: Column) -> Column:
    """Rewritten sentences of a text; an empty token has none."""
    if own == TOKEN:
        return F.filter(F.array(text), lambda s: s != "")
    sentences = F.filter(chain.base.split_document(text), lambda s: s != "") if own == DOCUMENT else F.array(text)
    return _apply(chain.before, sentences, 1)


def _split(chain: _Chain, own: Stage, sentences: Column) -> Column:
    """Tokens of words of rewritten sentences. Texts get no struct around them unless there are patterns: every level costs time by the token."""
    full = lambda a, test: F.filter(a, test)
    if own == TOKEN:
        return F.transform(sentences, lambda s: F.array(F.array(_piece(s) if chain.patterns else s)))
    if not chain.patterns:
        split = chain.base.split_subsentence if own == SUBSENTENCE else chain.base.split_sentence
        words = F.transform(sentences, lambda s: F.array(s) if own == WORD else full(split(s), lambda w: w != ""))
        words = _apply(chain.words, words, 2)
        if own == WORD or chain.words:
            words = F.transform(words, lambda ws: full(ws, lambda w: w != ""))
        return _tokens(chain, words, lambda w: full(chain.base.split_word(w), lambda t: t != ""))
    # pieces of every sentence
    pieces = F.transform(sentences, lambda s: matching.matchsplits(s, chain.patterns))
    if own != WORD:
        pieces = _rewritten(pieces, chain.inside, 2)
        part = lambda p: F.when(p["ismatch"], F.array(p)).otherwise(F.transform(full(chain.base.split_sentence(p["x"]), lambda w: w != ""), lambda x: _piece(x)))
        words = F.transform(pieces, lambda ps: F.flatten(F.transform(ps, part)))
    else:
        # a bare word: outside the match wrapper it counts as a sentence for normalizers, inside it doesn't
        words = pieces
    words = F.transform(_rewritten(words, chain.words, 2), lambda ws: full(ws, lambda w: w["x"] != ""))
    return _tokens(chain, words, lambda w: F.when(w["ismatch"], F.array(w)).otherwise(F.transform(full(chain.base.split_word(w["x"]), lambda t: t != ""), lambda x: _piece(x))))


def _tokens(chain: _Chain, words: Column, split: Callable[[Column], Column]) -> Column:
    """Each word's tokens; words without any are left out."""
    if not chain.splits_words:
        return F.transform(words, lambda ws: F.transform(ws, lambda w: F.array(w)))
    return F.transform(words, lambda ws: F.filter(F.transform(ws, split), lambda w: F.size(w) > 0))


def _numbered(plan: Any, stage: str | Stage, text: Column, document_id: Column | None, sentence_id: Column | None) -> Column:
    """array<array<token>>: sentences of tokens, with the metadata of the plan."""
    chain, own = _Chain.of(plan), kind(stage)

    def token(t: Column, s: Column | None, w: Column | None, k: Column | None) -> Column:
        fields = [(t["x"] if chain.patterns else t).alias("x")]
        if chain.indexed:
            if document_id is not None:
                fields.append(document_id.cast("int").alias("document_id"))
            if own == DOCUMENT:
                fields.append((s + 1).alias("sentence_id"))
            elif sentence_id is not None:
                fields.append(sentence_id.cast("int").alias("sentence_id"))
        if chain.patterns:
            fields.append(t["ismatch"].alias("ismatch"))
        if chain.indexed:
            fields += [w.alias("word_id"), k.alias("token_id")]
        return F.struct(*fields)

    deep = compiled(plan, stage, text)
    if not chain.indexed:
        return F.transform(deep, lambda ws: F.transform(F.flatten(ws), lambda t: token(t, None, None, None)))

    def numbered(ws: Column, s: Column) -> Column:
        pairs = F.flatten(F.transform(ws, lambda w, i: F.transform(w, lambda t: F.struct(t.alias("t"), (i + 1).alias("w")))))
        return F.transform(pairs, lambda p, k: token(p["t"], s, p["w"], k + 1))

    return F.transform(deep, numbered)


@dataclass(frozen=True, repr=False)
class FlatTokenizer(Node):
    """Tokens of a text in one array."""

    tokenization: Any = field(default_factory=DefaultTokenization)
    preprocess: Callable[[Column], Column] | None = None

    def apply(self, text: Column, stage: str | Stage = DOCUMENT, document_id: Column | None = None, sentence_id: Column | None = None) -> Column:
        text = self.preprocess(text) if self.preprocess else text
        return F.flatten(_numbered(self.tokenization, stage, text, document_id, sentence_id))

    def transform(self, df: DataFrame, column: str = "text", stage: str | Stage = DOCUMENT, into: str = "tokens") -> DataFrame:
        return df.withColumn(into, self.apply(F.col(column), stage))

    def rows(self, df: DataFrame, *keep: str, column: str = "text", stage: str | Stage = DOCUMENT) -> DataFrame:
        """A row for each token: ``keep`` and the fields that ``apply`` gives its tokens.

        Rows are made of sentences first, and of a sentence's plain arrays of texts and word numbers then: no token is
        put into structs, and no array is longer than a sentence.
        """
        chain, own = _Chain.of(self.tokenization), kind(stage)
        text = self.preprocess(F.col(column)) if self.preprocess else F.col(column)
        sentences = df.select(*keep, F.posexplode(_sentences(chain, own, text)).alias("_sentence", "_text"))

        def arrays(words: Column) -> Column:
            flat = F.flatten(words)
            fields = [(F.transform(flat, lambda t: t["x"]) if chain.patterns else flat).alias("x")]
            if chain.patterns:
                fields.append(F.transform(flat, lambda t: t["ismatch"]).alias("ismatch"))
            if chain.indexed and chain.splits_words:
                fields.append(F.flatten(F.transform(words, lambda w, i: F.array_repeat(i + 1, F.size(w)))).alias("word_id"))
            return F.struct(*fields)

        done = sentences.select(*keep, "_sentence", let(F.get(_split(chain, own, F.array("_text")), F.lit(0)), arrays).alias("_all"))
        done = done.select(*keep, "_sentence", "_all", F.posexplode("_all.x").alias("_at", "x"))
        at = F.col("_at") + 1
        fields = {"x": F.col("x")}
        if chain.indexed and own == DOCUMENT:
            fields["sentence_id"] = F.col("_sentence") + 1
        if chain.patterns:
            fields["ismatch"] = F.get("_all.ismatch", "_at")
        if chain.indexed:
            fields |= {"word_id": F.get("_all.word_id", "_at") if chain.splits_words else at, "token_id": at}
        return done.select(*keep, *[c.alias(k) for k, c in fields.items()])

    def __repr__(self) -> str:
        return f"FlatTokenizer({self.tokenization!r})"


@dataclass(frozen=True, repr=False)
class NestedTokenizer(Node):
    """Tokens by sentence; a bare word gives one array."""

    tokenization: Any = field(default_factory=DefaultTokenization)
    preprocess: Callable[[Column], Column] | None = None

    def apply(self, text: Column, stage: str | Stage = DOCUMENT, document_id: Column | None = None, sentence_id: Column | None = None) -> Column:
        text = self.preprocess(text) if self.preprocess else text
        out = _numbered(self.tokenization, stage, text, document_id, sentence_id)
        return F.flatten(out) if kind(stage) in (WORD, TOKEN) else out

    def transform(self, df: DataFrame, column: str = "text", stage: str | Stage = DOCUMENT, into: str = "tokens") -> DataFrame:
        return df.withColumn(into, self.apply(F.col(column), stage))

    def __repr__(self) -> str:
        return f"NestedTokenizer({self.tokenization!r})"


def tokenize_batch(df: DataFrame, tokenizer: FlatTokenizer | NestedTokenizer, order_by: str, column: str = "text", stage: str | Stage = DOCUMENT, batch_key: str | None = None, into: str = "tokens") -> DataFrame:
    """Rows as a batch: a document's number in it is its document_id, a sentence's its sentence_id.

    Numbers follow ``order_by`` within ``batch_key``; a batch is numbered in one task, so without a key use a frame that fits one.
    """
    number = F.row_number().over(Window.partitionBy(*([batch_key] if batch_key else [F.lit(0)])).orderBy(order_by))
    numbered = df.withColumn("_number", number)
    ids = {"document_id": F.col("_number")} if kind(stage) == DOCUMENT else {"sentence_id": F.col("_number")}
    return numbered.withColumn(into, tokenizer.apply(F.col(column), stage, **ids)).drop("_number")


def value(tokens: Column, depth: int = 1) -> Column:
    """Token texts of nested arrays."""
    return nested(lambda t: t["x"], depth)(tokens)


