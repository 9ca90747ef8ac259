"""Tokenizers over streams: plans never leave their row, so a stream of texts becomes a stream of tokens as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.vocab import Vocab
from lexiloom.plans.stages import DOCUMENT, Stage
from lexiloom.plans.tokenization import FlatTokenizer


def token_rows(texts: DataFrame, tokenizer: FlatTokenizer, key: str, column: str = "text", stage: str | Stage = DOCUMENT, vocab: Vocab | None = None) -> DataFrame:
    """(key, pos, token fields [, idx]): a row for each token, of a table or of a stream; a vocabulary is joined as a table."""
    out = texts.select(key, F.posexplode(tokenizer.apply(F.col(column), stage)).alias("pos", "token")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), "token.*")
    return vocab.encode_ids(out, "x") if vocab else out


def write_tokens(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then an end; later runs go on where this one stopped."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
