"""Small builders of scripts, witnesses and transaction rows for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

KEYS = ["source_id", "txid", "wtxid"]
TX = "source_id string, txid string, wtxid string, version int, is_coinbase boolean"
OUT = "source_id string, txid string, wtxid string, vout bigint, value_sats bigint, script binary"
IN = "source_id string, txid string, wtxid string, vin bigint, prev_txid string, prev_vout bigint, script_sig binary, sequence bigint, witness array<binary>, script binary, creation_height int"
P2TR, P2WPKH, P2WSH = b"\x51\x20" + b"\x11" * 32, b"\x00\x14" + b"\x22" * 20, b"\x00\x20" + b"\x33" * 32
P2SH, P2PKH = b"\xa9\x14" + b"\x44" * 20 + b"\x87", b"\x76\xa9\x14" + b"\x55" * 20 + b"\x88\xac"


def push(data: bytes) -> bytes:
    n = len(data)
    head = bytes([n]) if n < 0x4C else b"\x4c" + bytes([n]) if n < 256 else b"\x4d" + n.to_bytes(2, "little")
    return head + data


def tx(spark, rows):
    """rows: {name: dict(version, outputs=[(value, script)], inputs=[dict(script, sig, witness, sequence, prev, height)])}."""
    t, o, i = [], [], []
    for name, row in rows.items():
        key = ("s", name, name)
        t.append((*key, row.get("version", 2), row.get("coinbase", False)))
        o += [(*key, n, v, bytearray(s)) for n, (v, s) in enumerate(row.get("outputs", [(1000, P2WPKH)]))]
        for n, x in enumerate(row.get("inputs", [{"script": P2WPKH}])):
            script = x.get("script")
            i.append((*key, n, x.get("prev", "ab" * 32), 0, bytearray(x.get("sig", b"")), x.get("sequence", 0xFFFFFFFF), [bytearray(w) for w in x.get("witness", [])], None if script is None else bytearray(script), x.get("height")))
    frames = spark.createDataFrame(t, TX), spark.createDataFrame(o, OUT), spark.createDataFrame(i, IN)
    return tuple(f.withColumn("source_id", F.col("source_id")) for f in frames)
