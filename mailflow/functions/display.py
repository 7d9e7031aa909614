"""Display helpers of the work queues as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: display texts and formats ---------------------------------
WAITING_LABEL = "Aguardando"
SUBJECT_CUT = 80
TIMESTAMP_DISPLAY = "dd/MM/yyyy, HH:mm:ss"
# -----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_id(reply="id_resposta", protocol="id_protocolo", mail="id_email") -> Column:
    """reply id, else protocol id, else mail id (0 falls through)."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0)) for c in (reply, protocol, mail)])


def display_time(arrival="data_chegada", created="criado_em") -> Column:
    """arrival time of the reply, else creation time of the case."""
    return F.coalesce(_col(arrival), _col(created))


def display_status(validation="status_validacao", status="status") -> Column:
    """validation status, else case status, else the waiting label."""
    return F.coalesce(F.nullif(_col(validation), F.lit("")), F.nullif(_col(status), F.lit("")),
                      F.lit(WAITING_LABEL))


def subject_cut(subject="assunto") -> Column:
    """first 80 characters of the subject."""
    return F.substring(_col(subject), 1, SUBJECT_CUT)


def capitalize_first(text) -> Column:
    """upper-case the first character only (not ``initcap``)."""
    t = _col(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def format_timestamp(ts) -> Column:
    """``dd/MM/yyyy, HH:mm:ss`` display form."""
    return F.date_format(_col(ts), TIMESTAMP_DISPLAY)
