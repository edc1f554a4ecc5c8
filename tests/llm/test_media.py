import hashlib
import zlib

import numpy as np

from turnstone.llm import jpeg, media


def plain_decode(data):
    """A slow reader, a bit at a time, by the standard's flow charts. Returns coefficients of each component by block."""
    at, tables, restart, comps, out = 2, {}, 0, [], {}
    while data[at + 1] != 0xD9:
        code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xC4:
            codes, c, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[n, c] = body[k]
                    c, k = c + 1, k + 1
                c <<= 1
            tables[body[0]] = codes
        elif code == 0xDD:
            restart = int.from_bytes(body)
        elif code == 0xC2:
            h, w = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4) for i in range(body[5])]
            mx, my = w // 16, h // 16
            out = {i: np.zeros((mx * my * f * f, 64), int) for i, f in comps}
        elif code == 0xDA:
            n = body[0]
            own = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = at
            while not (data[end] == 255 and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            pieces, k, cur = [], at, bytearray()
            while k < end:
                if data[k] == 255 and 0xD0 <= data[k + 1] <= 0xD7:
                    pieces.append(cur)
                    cur, k = bytearray(), k + 2
                    continue
                cur.append(data[k])
                k += 2 if data[k] == 255 else 1
            pieces.append(cur)
            at = end
            order = []
            for y in range(my):
                for x in range(mx):
                    for i, f in comps if n > 1 else []:
                        order += [(i, (y * f + v) * mx * f + x * f + u) for v in range(f) for u in range(f)]
            if n == 1:
                order = [(own[0][0], b) for b in range(len(out[own[0][0]]))]
            step = restart * (6 if n > 1 else 1) or len(order)
            for p, piece in enumerate(pieces):
                bits = iter("".join(f"{x:08b}" for x in piece))
                take = lambda m: int("".join(next(bits) for _ in range(m)) or "0", 2)  # noqa: B023, E731

                def symbol(t):
                    c = m = 0
                    while True:
                        c, m = c << 1 | take(1), m + 1  # noqa: B023
                        if (m, c) in t:
                            return t[m, c]

                signed = lambda m: (lambda v: v if not m or v >> (m - 1) else v - (1 << m) + 1)(take(m))  # noqa: B023, E731
                pred, run = {}, 0
                for i, b in order[p * step : (p + 1) * step]:
                    row = out[i][b]
                    if ss == 0:
                        if ah:
                            row[0] |= take(1) << al
                        else:
                            pred[i] = pred.get(i, 0) + signed(symbol(tables[own[0][1] >> 4]))
                            row[0] = pred[i] << al
                        continue
                    t, k = tables[0x10 | own[0][1] & 15], ss
                    if ah == 0:
                        if run:
                            run -= 1
                            continue
                        while k <= se:
                            rs = symbol(t)
                            r, s = rs >> 4, rs & 15
                            if s == 0 and r < 15:
                                run = (1 << r) + take(r) - 1
                                break
                            k += r if s else 16
                            if s:
                                row[k] = signed(s) << al if s else 0
                                k += 1
                        continue
                    fix = lambda k: row.__setitem__(k, row[k] + (take(1) << al) * (1 if row[k] > 0 else -1))  # noqa: B023, E731
                    while k <= se and not run:
                        rs = symbol(t)
                        r, s = rs >> 4, rs & 15
                        if s == 0 and r < 15:
                            run = (1 << r) + take(r)
                            break
                        sign = take(1) if s else 0
                        while k <= se:
                            if row[k]:
                                fix(k)
                            elif r == 0:
                                if s:
                                    row[k] = (1 if sign else -1) << al
                                k += 1
                                break
                            else:
                                r -= 1
                            k += 1
                    if run:
                        for k in range(k, se + 1):
                            if row[k]:
                                fix(k)
                        run -= 1
        else:
            continue
    return [out[i] for i, _ in comps]


RNG = np.random.default_rng(0)
RAW = [b"", b"hello world " * 60, bytes(RNG.integers(0, 256, 1500).astype(np.uint8)), bytes([128] * 1300), bytes([129] * 600), bytes([127, 128] * 300), bytes(RNG.integers(126, 131, 1200).astype(np.uint8)), "é ü À Á ß ".encode() * 70]


def test_round_trip_and_a_plain_decoder():
    ps = [media.padded(x) for x in RAW]
    streams = jpeg.encode(ps)
    images, coefs = jpeg.decode(streams)
    for p, s, i in zip(ps, streams, images):
        assert jpeg.payload(i, coefs) == p and jpeg.encode([p]) == [s]
        mx, my = i.mcus()
        for (_, h, v, _), base, want in zip(i.components, i.bases, plain_decode(s)):
            assert (coefs[base : base + mx * my * h * v] == want).all()


def test_samples_against_the_definition():
    c = np.zeros((3, 64), int)
    c[0, 0], c[1, [0, 1, 5]], c[2] = 80, (-40, 100, -60), RNG.integers(-60, 60, 64)
    got = jpeg._samples(c)
    cells = [(v, u) for v, u in (divmod(int(z), 8) for z in jpeg.ZIGZAG)]
    assert cells[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and cells[-1] == (7, 7)
    k = lambda n: 2**-0.5 if n == 0 else 1.0
    for b in range(3):
        for y in range(8):
            for x in range(8):
                s = sum(c[b, z] * k(u) * k(v) / 4 * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for z, (v, u) in enumerate(cells))
                assert abs(np.clip(s + 128, 0, 255) - got[b, 8 * y + x]) < 0.6


def test_table(spark):
    rows = [(k, x.decode("latin-1"), "m") for k, x in enumerate(RAW)] + [(90, None, "m"), (91, "long text " * 20000, "m"), (None, "x", "m"), (2, "y", "m"), (2, "y", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.encode(df)
    out = media.digests(stored).collect()
    want = sorted((str(i), len(r := (t or "").encode()), len(p := media.padded(r)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    for r in stored.join(media.decode(stored).drop("n_bytes"), "doc_id").filter("doc_id in (1, 7)").collect():
        t = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        d = next(x for x in out if x.doc_id == r.doc_id)
        assert d.feature == media.feature(t) and d.media_sha256 == hashlib.sha256(r.media).hexdigest() and d.media_bytes == len(r.media)
    assert media.digests(media.encode(df.limit(0))).count() == 0


def test_stored_media_and_tensors(spark, tmp_path):
    rows = [(k, x.decode("latin-1")) for k, x in enumerate(RAW)]
    kept = media.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/media")
    assert sorted(kept.columns) == ["doc_id", "media", "n_bytes"]
    tensors = {r.doc_id: r for r in media.write_tensors(kept, f"file://{tmp_path}/tensors").collect()}
    found = {r.doc_id: r for r in media.digests(kept).collect()}
    assert set(tensors) == set(found) == {k for k, _ in rows}
    for k, text in rows:
        r, d = tensors[k], found[k]
        t = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert r.payload == media.padded(text.encode()) and d.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and d.feature == media.feature(t)


def test_scans_of_other_components_are_read_together(monkeypatch):
    calls = []
    for name in ("_ac_first", "_ac_refine", "_dc"):
        monkeypatch.setattr(jpeg, name, lambda *x, name=name, of=getattr(jpeg, name): (calls.append(name), of(*x)))
    rng = np.random.default_rng(8)
    payloads = [rng.integers(0, 256, n * 576, dtype=np.uint8).tobytes() for n in (1, 3, 40)] + [b"\xff" * 576, b"\x80" * 1152]
    images, coefs = jpeg.decode(jpeg.encode(payloads))
    assert [jpeg.payload(i, coefs) for i in images] == payloads
    assert calls == ["_dc", "_ac_first", "_dc", "_ac_refine"]
    # a component that stands again, or other parameters, end a turn
    scan = lambda c, ss, ah: ((c,), ("t",), ss, 63, ah, 0, 8, 0, 9)
    assert jpeg._turns([scan(0, 1, 1), scan(1, 1, 1), scan(0, 1, 1), scan(1, 1, 0), scan(2, 6, 0)]) == [[0, 1], [2], [3], [4]]
