"""One e-mail over many blocks, and mentions from a stream of files, against the pass in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from sequential import Resolver

from arbelo.layer import EntityLayer
from arbelo.operators import mentions
from arbelo.operators.resolve import Params
from arbelo.sources import synthetic
from arbelo.streaming import mentions as stream


@pytest.fixture(scope="module")
def layer(spark):
    """A layer in which most e-mails come from a few senders that several entities share."""
    sources = synthetic.generate(spark, 40, seed=11, noise=1.8)
    few = F.element_at(F.array(*[F.lit(m) for m in ("vendas@grupo-um.com.br", "ana@gmail.com", "compras@grupo-dois.com.br")]), 1 + F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)).cast("int"))
    hot = F.pmod(F.crc32(F.concat("id", F.lit("?")).cast("binary")), F.lit(10)) < 7
    sources["emails"] = sources["emails"].withColumn("de", F.when(hot, few).otherwise(F.col("de")))
    return EntityLayer.build(sources, Params(grupo="aprende"))


@pytest.fixture(scope="module")
def wanted(layer):
    seq = Resolver([r.asDict(recursive=True) for r in layer.records.collect()], layer.params)
    return seq.links, seq.pending


def said(layer):
    return layer.records.filter("papel = 'mencao'").select(*stream.COLUMNS)


def parts(layer):
    return layer.registry()


def test_blocks_of_one_email_run_side_by_side(layer, wanted, monkeypatch):
    ran = []
    run = mentions._run
    monkeypatch.setattr(mentions, "_run", lambda rows, final, p: ran.append(rows.select("k", "bloco").distinct().count()) or run(rows, final, p))
    monkeypatch.setattr(mentions, "HOT", 20)
    monkeypatch.setattr(mentions, "WIDTH", 9)
    links, pending = mentions.link(said(layer), *parts(layer), layer.params)
    assert {r.ref: (r.id, r.motivo) for r in links.collect()} == wanted[0]
    assert {r.ref: list(r.candidatos) for r in pending.collect()} == wanted[1]
    keys = said(layer).select(F.coalesce(F.nullif("email", F.lit("")), "ref")).distinct().count()
    assert ran[0] > keys + 10 and len(ran) > 2  # more blocks than e-mails, and some ran again


def test_a_stream_of_files_ends_in_the_batch_result(spark, layer, wanted, tmp_path, monkeypatch):
    rows = said(layer).toPandas()
    files = list(range(8))
    at = [random.Random(i).choice(files) if random.Random(i + 99).random() < 0.3 else i * 8 // len(rows) for i in range(len(rows))]  # three in ten come early or late
    for k in files:
        spark.createDataFrame(rows[[a == k for a in at]], stream.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    folder = f"file://{tmp_path}/out"
    link = stream.link_batch
    stopped = []

    def fails_once(batch, number, *rest):
        link(batch, number, *rest)
        if number == 3 and not stopped:
            stopped.append(number)
            raise RuntimeError("executor lost")

    monkeypatch.setattr(stream, "link_batch", fails_once)
    with pytest.raises(Exception, match="executor lost"):
        stream.link_stream(stream.read(spark, f"file://{tmp_path}/in"), folder, *parts(layer), layer.params).awaitTermination()
    stream.link_stream(stream.read(spark, f"file://{tmp_path}/in"), folder, *parts(layer), layer.params).awaitTermination()  # from its checkpoint
    told = stream.current(spark, folder).collect()
    assert len(told) == len(rows)
    assert {r.ref: (r.id, r.motivo) for r in told if r.id} == wanted[0]
    assert {r.ref: list(r.candidatos) for r in told if r.porque} == wanted[1]
