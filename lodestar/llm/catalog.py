"""The training-data queries and their SQL."""

from __future__ import annotations

from lodestar.llm import common, leakage, mixing, overlap, packing, scan, setjoin, spam, splitting, topn


def _alone(query):
    """The query, after what the one before kept is given back."""

    def run(spark, sf_dir):
        common.release()
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _alone(q) for k, q in _queries().items()}


def _queries() -> dict:
    return {
        "p1_found": splitting.p1_found,
        "p1_pieces": splitting.p1_pieces,
        "p1_rejoined": splitting.p1_rejoined,
        "p2_found": overlap.p2_found,
        "p2_report": overlap.p2_report,
        "p2_coverage": overlap.p2_coverage,
        "p2_opinions": overlap.p2_opinions,
        "p3_found": setjoin.p3_found,
        "p4_found": leakage.p4_found,
        "p4_leaks": leakage.p4_leaks,
        "p5_found": scan.p5_found,
        "p5_repaired": scan.p5_repaired,
        "p6_found": topn.p6_found,
        "p7_containers": packing.p7_containers,
        "p7_fill": packing.p7_fill,
        "p7_checked": packing.p7_checked,
        "p8_mixture": mixing.p8_mixture,
        "p8_shares": mixing.p8_shares,
        "p8_checked": mixing.p8_checked,
        "p9_found": spam.p9_found,
        "p9_scores": spam.p9_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {**splitting.SQL, **overlap.SQL, **setjoin.SQL, **topn.SQL, **packing.SQL, **mixing.SQL}
