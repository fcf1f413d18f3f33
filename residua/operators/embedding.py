"""Sequence embeddings through a pluggable embedder in a vectorised UDF.

An embedder is any object with ``embed(list[str]) -> list[list[float]]`` that pickles, or a function
that makes one; it is made once for each Python worker. One that has ``token_vectors`` gives a vector for each place
instead (an opening mark, the residues, a closing mark, padding up to the longest), and the mean is taken here:
over the residues, or, as an older release did, over all places of batches that were cut by number
(``embed_batches``). Batches are else sequences of like lengths under a budget of places, so that little is padding.
A sequence that can't be embedded gets null, so that labels, which stay in their rows, never shift. The test embedder
stands in where no language model is wanted; it is not one, and is only taken by its name.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from residua.functions.sequences import MAX_RESIDUES, truncate
from residua.operators.sampling import assign_batches

# Embedder names with parameters and layers.
MODELS = {
    "esm2_t6_8M_UR50D": {"params": "8M", "layers": 6},
    "esm2_t6_35M_UR50D": {"params": "35M", "layers": 6},
    "esm2_t6_150M_UR50D": {"params": "150M", "layers": 6},
    "esm2_t12_35M_UR50D": {"params": "35M", "layers": 12},
}
DEFAULT_MODEL = "esm2_t6_8M_UR50D"
CPU_BATCH = 4
GIB = 1024**3


class Embedder(Protocol):
    def embed(self, sequences: list[str]) -> list[list[float]]: ...


class LanguageModelEmbedder:
    """Mean over residues of a protein language model's sixth layer; torch and esm are needed where it runs."""

    LAYER = 6

    def __init__(self, name: str = DEFAULT_MODEL):
        try:
            import esm
            import torch
        except ImportError as e:
            raise RuntimeError(f"the embedder {name} needs torch and esm on every worker; choose another with --embedder") from e
        self.torch = torch
        at = device_address()
        self.device = torch.device(f"cuda:{at or 0}" if torch.cuda.is_available() else "cpu")
        model, alphabet = esm.pretrained.load_model_and_alphabet(name)
        self.model = model.eval().to(self.device)
        self.tokens_of = alphabet.get_batch_converter()
        self.batch = batch_size(torch.cuda.get_device_properties(self.device).total_memory if self.device.type == "cuda" else None, name)

    def token_vectors(self, sequences: list[str]) -> np.ndarray:
        _, _, tokens = self.tokens_of([("", s) for s in sequences])
        with self.torch.no_grad():
            return self.model(tokens.to(self.device), repr_layers=[self.LAYER], return_contacts=False)["representations"][self.LAYER].cpu().numpy()

    def embed(self, sequences: list[str]) -> list[list[float]]:
        return pooled(self.token_vectors(sequences), sequences)


class TestEmbedder:
    """A deterministic stand-in of no biological meaning: each dimension is a mean over residues of a small whole number."""

    __test__ = False

    def __init__(self, width: int = 16):
        self.width = width

    def embed(self, sequences: list[str]) -> list[list[float]]:
        return [self._one(s) for s in sequences]

    def _one(self, seq: str) -> list[float]:
        codes, counts = np.unique(np.frombuffer(seq.encode("utf-32-le"), "<u4").astype(np.int64), return_counts=True)
        values = (codes[:, None] * (2 * np.arange(self.width) + 3)) % 17 - 8
        return ((values * counts[:, None]).sum(axis=0) / max(1, len(seq))).tolist()


class TestTokenEmbedder(TestEmbedder):
    """The stand-in by places: marks and padding have vectors of their own, which a mean over all places takes in."""

    def token_vectors(self, sequences: list[str]) -> np.ndarray:
        out = np.full((len(sequences), max(map(len, sequences)) + 2, self.width), 7.0)
        for k, s in enumerate(sequences):
            codes = np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64)
            out[k, 0], out[k, len(s) + 1] = 3.0, 5.0
            out[k, 1 : len(s) + 1] = (codes[:, None] * (2 * np.arange(self.width) + 3)) % 17 - 8
        return out


def pooled(vectors: np.ndarray, sequences: list[str], all_places: bool = False) -> list[list[float]]:
    """Means over a sequence's residues, of zeros where it has none, or over all places of its batch."""
    if all_places:
        return vectors.mean(axis=1).tolist()
    return [vectors[k, 1 : len(s) + 1].mean(axis=0).tolist() if s else [0.0] * vectors.shape[2] for k, s in enumerate(sequences)]


def device_address() -> str | None:
    """The accelerator that Spark has dealt to this task, if any."""
    task = TaskContext.get()
    found = task.resources().get("gpu") if task else None
    return found.addresses[0] if found and found.addresses else None


def length_groups(lengths: list[int], places: int, most: int | None = None) -> list[list[int]]:
    """Indexes in groups of like lengths: the longest and its two marks, times their number, stay within ``places`` (one is always taken)."""
    groups: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        width = lengths[groups[-1][0]] + 2 if groups else 0
        if groups and (len(groups[-1]) + 1) * width <= places and (most is None or len(groups[-1]) < most):
            groups[-1].append(k)
        else:
            groups.append([k])
    return groups


def padding_share(lengths: list[int], groups: list[list[int]]) -> float:
    """What part of the places that are computed is padding."""
    computed = sum(len(g) * (max(lengths[k] for k in g) + 2) for g in groups)
    return 1 - sum(n + 2 for n in lengths) / computed if computed else 0.0


def factory(spec: str, model_name: str = DEFAULT_MODEL) -> Callable[[], Embedder]:
    """How to make an embedder: ``esm`` (with the model's name), ``test``, or ``module:callable``, looked up where it runs."""
    if spec == "esm":
        return functools.partial(LanguageModelEmbedder, model_name)
    if spec == "test":
        return TestEmbedder
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec}: an embedder is named esm, test or module:callable")
    return functools.partial(_make, module, name)


def _make(module: str, name: str) -> Embedder:
    return getattr(importlib.import_module(module), name)()


_MADE: dict[str, Embedder] = {}


def made(make: Callable[[], Embedder], name: str) -> Embedder:
    """This worker's embedder."""
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def vectors_of(model: Embedder, sequences: list[str]) -> list[list[float]]:
    return pooled(model.token_vectors(sequences), sequences) if hasattr(model, "token_vectors") else model.embed(sequences)


def embed_all(model: Embedder, sequences: list[str], batch: int = CPU_BATCH) -> list[list[float] | None]:
    """Vectors of all sequences, in groups of like lengths; the budget is what ``batch`` of the longest take, or what the embedder says."""
    out: list[list[float] | None] = [None] * len(sequences)
    size = getattr(model, "batch", batch)
    for group in length_groups([len(s) for s in sequences], size * (MAX_RESIDUES + 2)):
        some = [sequences[k] for k in group]
        try:
            found = vectors_of(model, some)
        except Exception:  # one bad sequence must not lose its neighbours
            found = []
            for s in some:
                try:
                    found += vectors_of(model, [s])
                except Exception:
                    found.append(None)
        for k, v in zip(group, found, strict=True):
            out[k] = v
    return out


def embed_column(sequence: Column, make: Callable[[], Embedder], name: str = DEFAULT_MODEL, batch: int = CPU_BATCH) -> Column:
    """Embeddings of the first 1022 residues. Declared nondeterministic, so that a filter on it never runs it twice."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = made(make, name)
        for texts in batches:
            known = [k for k, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for k, v in zip(known, embed_all(model, [texts.iloc[k] for k in known], batch), strict=True):
                out[k] = v
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return udf(truncate(sequence))


def accelerator_profile(per_executor: int = 1, tasks_each: int = 1) -> ResourceProfile:
    """What the inference stage asks of its executors: accelerators, and how many tasks share one."""
    executor = ExecutorResourceRequests().resource("gpu", per_executor)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().resource("gpu", 1 / tasks_each)).build


def embed_stage(df: DataFrame, sequence: str, make: Callable[[], Embedder], name: str = DEFAULT_MODEL, profile: ResourceProfile | None = None, batch: int = CPU_BATCH) -> DataFrame:
    """Adds ``embedding`` in a stage of its own, on executors of ``profile`` where one is given, else where all else runs.

    Each worker makes its embedder on the device of its task's address and takes the batch that this reports.
    """
    plain = df.toDF(*(f"column_{k}" for k in range(len(df.columns))))  # names of any kind come back at the end
    schema = StructType([*plain.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    arrow = to_arrow_schema(schema)
    at = df.columns.index(sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(make, name)
        for rows in batches:
            texts = [None if t is None else t[:MAX_RESIDUES] for t in rows.column(at).to_pylist()]
            known = [k for k, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for k, v in zip(known, embed_all(model, [texts[k] for k in known], batch), strict=True):
                out[k] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, arrow.field("embedding").type)], names=arrow.names)

    return plain.mapInArrow(run, schema, profile=profile).toDF(*df.columns, "embedding")


def embed_batches(df: DataFrame, sequence: str, key: str, make: Callable[[], Embedder], name: str = DEFAULT_MODEL, size: int = CPU_BATCH) -> DataFrame:
    """Adds ``embedding`` as means over all places of batches of ``size`` sequences in order of ``key``, marks and padding included.

    ``key`` must be unique. A batch that can't be embedded has nulls. Null sequences count as empty.
    """
    rows = assign_batches(df, key, size).withColumn(sequence, truncate(F.coalesce(sequence, F.lit(""))))
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    kind = to_arrow_schema(schema).field("embedding").type

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        texts = table.column(sequence).to_pylist()
        try:
            found = pooled(made(make, name).token_vectors(texts), texts, all_places=True)
        except Exception:  # the batch goes, as a whole
            found = [None] * len(texts)
        return table.append_column("embedding", pa.array(found, kind))

    return rows.groupBy("batch").applyInArrow(run, schema).drop("batch")


def embed(df: DataFrame, sequence: str, make: Callable[[], Embedder], name: str = DEFAULT_MODEL) -> DataFrame:
    """Adds ``embedding``; filter on cheap columns before, on nulls after."""
    return df.withColumn("embedding", embed_column(F.col(sequence), make, name))


def batch_size(memory_bytes: int | None, model: str) -> int:
    """Sequences at once: by accelerator memory and model, or for a CPU where there is none."""
    if memory_bytes is None:
        return CPU_BATCH
    per, low, high = (2, 4, 32) if "t6_8M" in model else (4, 2, 16) if "t12_35M" in model else (3, 2, 8)
    return min(high, max(low, memory_bytes // (per * GIB)))
