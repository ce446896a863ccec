"""Regression: published pilot metrics from the published scores."""

import pytest

from ledgerproof.operators import detectors as det

# Label and max_token_entropy of the 135 pilot spans, in row order.
PILOT = """
    0:0.000412 0:0.051386 1:1.190812 1:0.694009 1:2.178043 0:0.000511 0:0.454678 0:1.339111 0:1.232375 1:1.486878 1:0.798342 0:0.002990
    1:0.877312 0:0.173386 0:0.600885 0:0.097207 1:1.707712 0:1.098467 1:2.197358 0:0.814648 0:0.000846 1:1.795437 1:0.699937 1:1.375842
    1:0.128661 1:0.005369 0:0.005814 0:0.177086 0:1.157635 1:0.835559 0:0.871483 0:1.196185 0:0.000814 1:1.540120 1:0.879369 1:0.664788
    1:1.413013 0:0.002582 1:1.068096 1:1.995473 0:1.293273 0:0.017226 0:1.390200 0:1.463977 0:0.052461 0:0.004339 0:0.000422 1:1.853686
    1:2.290304 0:1.432086 0:0.645132 0:0.060502 0:0.000320 0:0.000110 1:0.825841 0:1.994314 0:0.000517 1:1.083136 1:0.088318 1:0.863110
    0:0.012723 1:0.059637 0:0.000486 1:1.422108 1:0.048961 1:0.032788 1:0.577657 0:0.009899 1:1.849683 0:0.009615 0:0.141002 0:1.185389
    0:0.149601 0:0.844898 0:1.081313 0:0.937472 0:0.000732 0:1.165575 0:0.009220 0:0.686295 0:1.649730 0:0.830557 1:1.811630 1:0.611643
    1:2.423340 0:0.001282 0:0.438417 1:1.709117 0:0.000773 1:0.525284 1:0.785478 1:1.222222 1:0.000085 1:0.675674 1:0.000364 0:0.000093
    0:0.128818 0:0.000182 0:1.006919 0:1.338591 0:0.000922 0:0.002018 0:0.388322 1:2.298537 0:0.000972 1:0.531932 1:0.966272 1:1.017789
    1:0.000092 1:1.160970 1:0.000384 1:0.000108 1:1.653462 1:0.002476 0:1.224840 1:0.457748 1:0.964865 1:1.400933 1:1.081625 1:0.000383
    1:0.869572 1:0.000870 1:0.001150 1:0.000143 1:1.508769 1:0.090445 1:0.420056 1:3.109305 0:1.622077 1:0.002466 1:0.208859 1:0.687486
    0:0.593332 0:0.013194 1:2.146412
"""
# The published metrics of that detector, threshold chosen on the same spans.
WANT = {
    "threshold": 0.032788, "precision": 0.59375, "recall": 0.826087, "specificity": 0.409091, "f1": 0.690909, "accuracy": 0.622222,
    "auroc": 0.655468, "auprc": 0.70288, "tp": 57, "fp": 39, "tn": 27, "fn": 12,
}


def test_pilot_metrics(spark):
    pairs = [p.split(":") for p in PILOT.split()]
    rows = [("max_token_entropy", "train", i, int(y), float(s)) for i, (y, s) in enumerate(pairs)]
    assert len(rows) == 135 and sum(r[3] for r in rows) == 69
    df = spark.createDataFrame(rows, "baseline string, split string, row_id long, y int, score double")
    swept = det.sweep(df)
    best = det.best_thresholds(swept).first().asDict()
    best |= {"auroc": det.auroc(swept).first()["auroc"], "auprc": det.average_precision(df).first()["auprc"]}
    for name, value in WANT.items():
        assert round(best[name], 6) == pytest.approx(value, abs=1e-9), name
