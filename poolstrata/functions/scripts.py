"""Script and witness functions. Families and witness programs are native byte slicing; instruction lists (and ARC4) are the
only Python, as Arrow functions on columns of scripts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import c

OPS = "array<struct<pos: int, op: int, data: binary>>"
DECODED_ARROW = pa.struct([("ok", pa.bool_()), ("ops", pa.list_(pa.struct([("pos", pa.int32()), ("op", pa.int32()), ("data", pa.binary())])))])
OP_RETURN, OP_IF, OP_NOTIF, OP_ENDIF, OP_CHECKMULTISIG = 0x6A, 0x63, 0x64, 0x68, 0xAE
#: OP_SUCCESS opcodes of Tapscript, as ranges (BIP 342).
OP_SUCCESS = ((80, 80), (98, 98), (126, 129), (131, 134), (137, 138), (141, 142), (149, 153), (187, 254))


def x(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def at(script: Column, k: int) -> Column:
    """The byte at place k (from 0; negative from the end) as two hex digits; empty beyond the script."""
    return F.hex(F.substring(script, k + 1 if k >= 0 else k, 1))


def number_at(script: Column, k: int) -> Column:
    return F.conv(at(script, k), 16, 10).cast("int")


def witness_version(script: Column | str) -> Column:
    """Version of a witness program (4..42 bytes, version opcode, one push of the rest), else NULL."""
    s = c(script)
    n, op = F.length(s), number_at(s, 0)
    version = F.when(op == 0, F.lit(0)).when((op >= 0x51) & (op <= 0x60), op - 0x50)
    return F.when(n.between(4, 42) & (number_at(s, 1) == n - 2), version)


def script_family(script: Column | str, decoded: Column | None = None) -> Column:
    """Family of a script, the first that matches. ``decoded`` (from decode) tells bare multisig; without it a native test on
    the pushes' sizes is used, which covers keys of 33 and 65 bytes."""
    s = c(script)
    n, version = F.length(s), witness_version(script)
    starts = lambda text: F.startswith(s, x(text))
    ends = lambda text: F.endswith(s, x(text))
    multisig = is_bare_multisig(decoded) if decoded is not None else F.hex(s).rlike("^5[1-9A-F](21[0-9A-F]{66}|41[0-9A-F]{130}){1,16}(5[1-9A-F]|60)AE$")
    return (
        F.when(((n == 35) & starts("21") | (n == 67) & starts("41")) & ends("AC"), "p2pk")
        .when(multisig, "bare_multisig")
        .when((n == 25) & starts("76A914") & ends("88AC"), "p2pkh")
        .when((n == 23) & starts("A914") & ends("87"), "p2sh")
        .when((version == 0) & (n == 22), "p2wpkh")
        .when((version == 0) & (n == 34), "p2wsh")
        .when((version == 1) & (n == 34), "p2tr")
        .when(s == x("51024E73"), "p2a")
        .when(version.isNotNull(), "unknown_witness_program")
        .when(starts("6A"), "op_return")
        .otherwise("unknown_script")
    )


def instructions(script: bytes) -> tuple[bool, list[dict]]:
    """(place, opcode, pushed bytes) in order; False after a push that runs past the end. OP_0 pushes nothing."""
    out, k, n = [], 0, len(script)
    while k < n:
        pos, op = k, script[k]
        k += 1
        if op > 0x4E:
            out.append({"pos": pos, "op": op, "data": None})
            continue
        width = {0x4C: 1, 0x4D: 2, 0x4E: 4}.get(op, 0)
        if k + width > n:
            return False, out
        size = int.from_bytes(script[k : k + width], "little") if width else op
        k += width
        if k + size > n:
            return False, out
        out.append({"pos": pos, "op": op, "data": script[k : k + size]})
        k += size
    return True, out


DECODED_TYPE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("ops", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("op", T.IntegerType()), T.StructField("data", T.BinaryType())])))])


@F.arrow_udf(DECODED_TYPE)
def decode(scripts: pa.Array) -> pa.Array:
    """Instructions of each script; NULL for NULL. ok is false where the last push is cut off."""
    coded = scripts.dictionary_encode()  # a script that a batch has many times is decoded once
    decoded = [dict(zip(("ok", "ops"), instructions(script), strict=True)) for script in coded.dictionary.to_pylist()]
    return pa.array(decoded, DECODED_ARROW).take(coded.indices)


def arc4(key: bytes, data: bytes) -> bytes:
    """RC4 with its published key schedule; used on carriers only."""
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


#: How many states (of 256 bytes) are worked on at a time.
ARC4_ROWS = 2048


def arc4_each(keys: list[bytes], texts: list[bytes]) -> list[bytes]:
    """arc4 of many rows at once: each step of the schedule and each byte of the texts is one operation over all of them."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))  # the longest first: the rows that go on are the first ones
    out: list[bytes] = [b""] * len(texts)
    for start in range(0, len(order), ARC4_ROWS):
        chosen = order[start : start + ARC4_ROWS]
        rows, sizes = np.arange(len(chosen)), np.array([len(texts[k]) for k in chosen])
        key = np.frombuffer(b"".join((keys[k] * (255 // len(keys[k]) + 1))[:256] for k in chosen), np.uint8).reshape(-1, 256).T
        state, j = np.repeat(np.arange(256, dtype=np.uint8)[:, None], len(chosen), axis=1), np.zeros(len(chosen), np.uint8)
        for i in range(256):
            here = state[i].copy()
            j = j + here + key[i]
            state[i] = state[j, rows]
            state[j, rows] = here
        stream, j = np.zeros((int(sizes[0]), len(chosen)), np.uint8), np.zeros(len(chosen), np.uint8)
        for n in range(int(sizes[0])):
            live = rows[: np.searchsorted(-sizes, -n)]  # those longer than n
            i, m = (n + 1) & 255, len(live)
            here = state[i, :m].copy()
            j = j[:m] + here
            there = state[j, live]
            state[i, :m] = there
            state[j, live] = here
            stream[n, :m] = state[here + there, live]
        for column, k in zip(np.ascontiguousarray(stream.T), chosen, strict=True):
            out[k] = (np.frombuffer(texts[k], np.uint8) ^ column[: len(texts[k])]).tobytes()
    return out


@F.arrow_udf(T.BinaryType())
def arc4_apply(keys: pa.Array, payloads: pa.Array) -> pa.Array:
    rows = list(zip(keys.to_pylist(), payloads.to_pylist(), strict=True))
    asked = [k for k, (key, text) in enumerate(rows) if key and text is not None]
    out: list[bytes | None] = [None] * len(rows)
    for k, text in zip(asked, arc4_each([rows[k][0] for k in asked], [rows[k][1] for k in asked]), strict=True):
        out[k] = text
    return pa.array(out, pa.binary())


def pushes_over(decoded: Column, limit: int) -> Column:
    return F.filter(decoded["ops"], lambda o: o["data"].isNotNull() & (F.length(o["data"]) > limit))


def op_successes(decoded: Column) -> Column:
    def hit(o: Column) -> Column:
        any_of = F.lit(False)
        for low, high in OP_SUCCESS:
            any_of = any_of | o["op"].between(low, high)
        return o["data"].isNull() & any_of

    return F.filter(decoded["ops"], hit)


def first_op_if(decoded: Column) -> Column:
    return F.try_element_at(F.filter(decoded["ops"], lambda o: o["data"].isNull() & o["op"].isin(OP_IF, OP_NOTIF)), F.lit(1))


def push_only(decoded: Column) -> Column:
    return decoded["ok"] & F.forall(decoded["ops"], lambda o: o["data"].isNotNull() | (o["op"] == 0x4F) | o["op"].between(0x51, 0x60))


def concat_binary(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))


def op_return_payload(script: Column, tail_decoded: Column) -> Column:
    """Pushes after OP_RETURN, joined; all bytes after it where they aren't pushes only."""
    tail = F.substring(script, 2, 1 << 30)
    plain = tail_decoded["ok"] & F.forall(tail_decoded["ops"], lambda o: o["data"].isNotNull())
    return F.when(plain, concat_binary(F.transform(tail_decoded["ops"], lambda o: o["data"]))).otherwise(tail)


def bare_multisig(decoded: Column) -> Column:
    """struct<required, keys> of OP_m keys OP_n OP_CHECKMULTISIG, else NULL."""
    ops = decoded["ops"]
    n = F.size(ops)
    first, total, last = (F.try_element_at(ops, F.lit(k)) for k in (1, -2, -1))
    number = lambda o: F.when(o["data"].isNull() & o["op"].between(0x51, 0x60), o["op"] - 0x50)
    middle = F.slice(ops, 2, F.greatest(n - 3, F.lit(0)))
    ok = decoded["ok"] & (n >= 4) & last["data"].isNull() & (last["op"] == OP_CHECKMULTISIG) & F.forall(middle, lambda o: o["data"].isNotNull()) & (number(total) == n - 3) & (number(first) <= number(total))
    return F.when(ok, F.struct(number(first).alias("required"), F.transform(middle, lambda o: o["data"]).alias("keys")))


def is_bare_multisig(decoded: Column) -> Column:
    return F.coalesce(bare_multisig(decoded).isNotNull(), F.lit(False))


def key_payload(key: Column) -> Column:
    """The 31 bytes between a 33-byte slot's first and last."""
    return F.when(F.length(key) == 33, F.substring(key, 2, 31))


def annex_candidate(witness: Column) -> Column:
    return F.coalesce((F.size(witness) >= 2) & (at(F.try_element_at(witness, F.lit(-1)), 0) == "50"), F.lit(False))


def taproot(witness: Column) -> Column:
    """struct<annex, key_path, args, script, control> of a Taproot spend's witness; NULL when empty."""
    annex = annex_candidate(witness)
    stack = F.when(annex, F.slice(witness, 1, F.greatest(F.size(witness) - 1, F.lit(0)))).otherwise(witness)
    n = F.size(stack)
    path = n >= 2
    return F.when(
        F.size(witness) > 0,
        F.struct(
            annex.alias("annex"), (n == 1).alias("key_path"),
            F.when(path, F.slice(stack, 1, F.greatest(n - 2, F.lit(0)))).alias("args"),
            F.when(path, F.try_element_at(stack, F.lit(-2))).alias("script"), F.when(path, F.try_element_at(stack, F.lit(-1))).alias("control"),
        ),
    )


def aligned_control(control: Column) -> Column:
    n = F.length(control)
    return (n >= 33) & ((n - 33) % 32 == 0)


def canonical_single_push(script: Column, data: Column) -> Column:
    """Whether script is exactly the shortest plain push of data."""
    n = F.length(data)
    little = lambda width: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(width))))
    head = F.when(n < 0x4C, little(1)).when(n < 0x100, F.concat(x("4C"), little(1))).when(n < 0x10000, F.concat(x("4D"), little(2))).otherwise(F.concat(x("4E"), little(4)))
    return script == F.concat(head, data)


def explicit_rbf(inputs: Column | str) -> Column:
    return F.exists(c(inputs), lambda i: i["sequence"] < 0xFFFFFFFE)


def contains_bytes(data: Column, marker: bytes) -> Column:
    """Whether marker occurs at a whole byte of data."""
    return F.coalesce(F.contains(data, F.lit(marker)), F.lit(False))


def ord_envelope(decoded: Column) -> Column:
    """struct<found, body>: the first OP_FALSE OP_IF "ord" envelope. After it tag and value pushes are skipped in twos until an
    empty push opens the body; any opcode ends it. The body is its pushes joined."""
    ops = F.when(decoded["ok"], decoded["ops"]).otherwise(F.expr(f"cast(array() as {OPS})"))
    step = F.aggregate(
        ops,
        F.expr("named_struct('state', 0, 'body', cast(X'' as binary))"),
        # 0 looking, 1 after OP_FALSE, 2 after OP_IF, 3 before a tag, 4 before its value, 5 body, 6 over
        lambda a, o: F.struct(
            F.when(a["state"] >= 6, a["state"])
            .when(a["state"] == 5, F.when(o["data"].isNotNull(), 5).otherwise(6))
            .when(a["state"] == 4, F.when(o["data"].isNotNull(), 3).otherwise(6))
            .when(a["state"] == 3, F.when(o["data"].isNull(), 6).when(F.length(o["data"]) == 0, 5).otherwise(4))
            .when((a["state"] == 2) & (o["data"] == F.lit(b"ord")), 3)
            .when((a["state"] == 1) & o["data"].isNull() & (o["op"] == OP_IF), 2)
            .when(o["data"].isNotNull() & (F.length(o["data"]) == 0), 1)
            .otherwise(0).alias("state"),
            F.when((a["state"] == 5) & o["data"].isNotNull(), F.concat(a["body"], o["data"])).otherwise(a["body"]).alias("body"),
        ),
    )
    return F.struct((step["state"] >= 3).alias("found"), step["body"].alias("body"))


def is_brc20(body: Column) -> Column:
    bare = F.regexp_replace(F.hex(body), "(?:^|\\G)((?:(?!09|0A|0C|0D|20)..)*)(?:09|0A|0C|0D|20)", "$1")
    return F.contains(F.unhex(bare), F.lit(b'"p":"brc-20"'))
