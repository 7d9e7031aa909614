"""Plan regressions: pushdown, pruning, top-k and map-side combining."""

from pyspark.sql import functions as F

from mailflow.operators import boards as B
from mailflow.operators import capture as K
from mailflow.operators.common import desc_nf, on_date, optional_filters, top_k
from mailflow.sources.fixtures import stored_fixtures

from .conftest import SF_SMALL


def _plan(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_date_and_type_filters_reach_the_scan(spark):
    t = stored_fixtures(spark, SF_SMALL)
    e = t.emails.select("id_email", "recebido_em", "tipo_email")
    e = on_date(optional_filters(e, tipo_email="protocolo"), "recebido_em", "1996-03-15")
    plan = _plan(e)
    assert "EqualTo(tipo_email,protocolo)" in plan
    assert "GreaterThanOrEqual(recebido_em" in plan and "LessThan(recebido_em" in plan
    assert "corpo_email" not in plan  # pruned


def test_page_is_a_take_ordered(spark):
    t = stored_fixtures(spark, SF_SMALL)
    page = top_k(t.emails, [desc_nf("recebido_em"), F.col("id_email")], 100)
    assert "TakeOrderedAndProject" in _plan(page)


def test_backlog_plans_as_anti_join(spark):
    t = stored_fixtures(spark, SF_SMALL)
    plan = _plan(B.validation_backlog(t.emails, t.protocolos))
    assert "LeftAnti" in plan


def test_attachment_counts_combine_map_side(spark):
    t = stored_fixtures(spark, SF_SMALL)
    plan = _plan(B.attachment_counts(t.anexos_email))
    assert "partial_count" in plan


def test_outcomes_read_bodies_of_messages_without_an_id_alone(spark, scratch):
    t = stored_fixtures(spark, SF_SMALL)
    existing = t.emails.select("message_id")
    for df in (K.outcomes(t.captura, existing, "a@b.c"), K.summary(t.captura, existing, "a@b.c"), K.new_keys(t.captura, existing, "a@b.c")):
        plan = _plan(df)
        scans = [s.split("\n\n")[0] for s in plan.split("Scan parquet")[1:] if "ReadSchema" in s.split("\n\n")[0]]
        wide = [s for s in scans if "corpo_email" in s.split("ReadSchema")[1]]
        assert len(scans) > len(wide) > 0
        assert all("IsNull(message_id)" in s for s in wide)
