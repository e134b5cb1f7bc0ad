"""Audio as bytes, made of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _little(value: Column, size: int) -> Column:
    """A whole number as hexadecimal digits of so many bytes, the lowest first; a negative one as its two's complement."""
    digits = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def wav(samples: Column, rate: int = 44_100, channels: int = 1) -> Column:
    """16-bit samples (an array of whole numbers, channels in turn) as a WAV file; values beyond 16 bits are cut to them."""
    cut = F.transform(samples, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), x.cast("int"))))
    size = 2 * F.size(samples)
    tag = lambda text: F.lit(text.encode().hex())
    head = [tag("RIFF"), _little(size + 36, 4), tag("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(channels), 2), _little(F.lit(rate), 4),
            _little(F.lit(2 * rate * channels), 4), _little(F.lit(2 * channels), 2), _little(F.lit(16), 2), tag("data"), _little(size, 4)]
    return F.unhex(F.concat(*head, F.array_join(F.transform(cut, lambda x: _little(x, 2)), "")))
