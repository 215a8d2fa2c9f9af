"""Published summary values that the statistics must reproduce within their printed rounding."""

import numpy as np

from vigilspark.functions import distributions as dist
from vigilspark.operators import inference

# fixed values: raw equivalence p, adjusted p, interval ends at 90 %, mean difference, upper end at 95 % (n = 17, nine arms)
EQUIVALENCE = [
    (1.0, 1.0, -0.1736, -0.1337, -0.1536, -0.1295),
    (0.9867, 1.0, -0.029, -0.0131, -0.0211, -0.0115),
    (0.036, 0.108, -0.0094, 0.0023, -0.0035, 0.0036),
    (0.0001, 0.0007, -0.0039, 0.0033, -0.0003, 0.004),
    (0.0007, 0.0035, -0.0046, 0.0043, -0.0001, 0.0053),
    (0.0, 0.0, -0.002, 0.0027, 0.0004, 0.0032),
    (0.0011, 0.0043, -0.0037, 0.0051, 0.0007, 0.0061),
    (0.0, 0.0004, -0.0023, 0.0039, 0.0008, 0.0045),
    (0.0001, 0.0004, -0.0016, 0.0043, 0.0013, 0.0049),
]


def test_step_down_adjustment(spark):
    rows = [("arms", i, r[0], r[1]) for i, r in enumerate(EQUIVALENCE)]
    got = inference.holm(spark.createDataFrame(rows, "family string, i int, p double, want double"), ["family"], "p", tie="i").toPandas()
    assert np.abs(got.holm_p - got.want).max() < 5e-4


def test_interval_widths():
    ratio = dist.t_quantile(0.975, 16) / dist.t_quantile(0.95, 16)
    for _, _, lo, hi, mean, hi95 in EQUIVALENCE:
        assert abs(mean + (hi - lo) / 2 * ratio - hi95) < 1.8e-4


def test_factorial_design(spark):
    cells = [("p", "off", "off", 0.2728), ("p", "off", "on", 0.2725), ("p", "on", "off", 0.2665), ("p", "on", "on", 0.2712)]
    r = inference.factorial_effects(spark.createDataFrame(cells, "dataset string, first string, second string, mean double"), ["dataset"]).first()
    assert np.allclose([r.effect_first, r.effect_second, r.interaction], [-0.0038, 0.0022, 0.0050], atol=1e-4)
