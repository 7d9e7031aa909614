"""Oracle SQL for the registered queries (DuckDB dialect, ANSI where possible).

The data-model views are defined once as SQL over the driver tables (the
rules of FIXTURES.md plus the extension views documented there) and prepended
as CTEs to each query that needs them. Patterns never carry ``(?U)`` here: in
RE2 that flag means "ungreedy".
"""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {}
FIXTURE_SQL["emails0"] = """
SELECT o_orderkey AS id_email, '<' || CAST(o_orderkey AS STRING) || '@fixture.example>' AS message_id,
 CASE WHEN o_custkey % 5 = 0 THEN 'outro@example.com' ELSE 'respostas@example.com' END AS remetente,
 CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN 'Resposta de Ofício ' || lpad(CAST(o_orderkey AS STRING),7,'0') || '-' || lpad(CAST(o_orderkey % 97 AS STRING),2,'0') || '.1998.8.26.' || lpad(CAST(o_custkey % 10000 AS STRING),4,'0') || ' OPAJ: ' || CAST(o_custkey AS STRING) || ' FNDA-' || lpad(CAST(o_orderkey AS STRING),6,'0') || ' RESPOSTA PARCIAL / resposta final'
  WHEN 1 THEN 'ofício ' || lpad(CAST(o_orderkey AS STRING),9,'7') || ' opaj' || CAST(o_custkey AS STRING) || ' dila ' || lpad(CAST(o_orderkey AS STRING),7,'1') || ' Dilação'
  WHEN 2 THEN 'Cancelamento do pedido ' || CAST(o_custkey AS STRING)
  WHEN 3 THEN 'Comunicado interno sobre bloqueio'
  WHEN 4 THEN 'RESPOSTA MONITORAMENTO ' || lpad(CAST(o_orderkey AS STRING),20,'5')
  ELSE NULL END AS assunto,
 o_orderdate AS recebido_em,
 CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'curto' WHEN 2 THEN 'Segue anexo o comprovante de bloqueio do processo.'
  WHEN 3 THEN 'Referente ao processo ' || lpad(CAST(o_orderkey AS STRING),7,'0') || '-' || lpad(CAST(o_orderkey % 97 AS STRING),2,'0') || '.1998.8.26.' || lpad(CAST(o_custkey % 10000 AS STRING),4,'0') || ', documento em anexo.' ELSE 'Encaminhamos a resposta ao juizo solicitante.' END AS corpo_email
FROM orders"""
FIXTURE_SQL["emails"] = """
SELECT *, CASE WHEN lower(coalesce(assunto,'')) LIKE '%ofício%' OR lower(coalesce(assunto,'')) LIKE '%resposta%' THEN 'protocolo'
 WHEN lower(coalesce(assunto,'')) LIKE '%cancelamento%' OR lower(coalesce(assunto,'')) LIKE '%desistência%' THEN 'cancelamento'
 WHEN lower(coalesce(assunto,'')) LIKE '%comunicação%' OR lower(coalesce(assunto,'')) LIKE '%comunicado%' THEN 'comunicacao' ELSE 'outro' END AS tipo_email FROM emails0"""
FIXTURE_SQL["anexos_email"] = """
SELECT l_orderkey * 10 + l_linenumber AS id_anexo, l_orderkey AS id_email,
 CASE l_linenumber WHEN 1 THEN 'Minuta_' || CAST(l_orderkey AS STRING) || '.pdf' WHEN 2 THEN 'Certificado_Assinatura.pdf' WHEN 3 THEN 'anexos.zip' WHEN 4 THEN 'comprovante_bloqueio.PDF' ELSE 'extrato_' || CAST(l_linenumber AS STRING) END AS nome_arquivo,
 CASE WHEN l_linenumber IN (1,2,4) THEN 'application/pdf' WHEN l_linenumber = 3 THEN 'application/zip' ELSE NULL END AS tipo_arquivo
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d"""
FIXTURE_SQL["anexos_conteudo"] = """
SELECT l_orderkey * 10 + l_linenumber AS id_anexo,
 CASE WHEN l_linenumber = 7 THEN '' ELSE '%PDF-fixture ' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS conteudo
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d"""
FIXTURE_SQL["protocolos"] = """
SELECT o_orderkey + 1000000 AS id_protocolo, o_orderkey AS id_email, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey + 2000000 END AS id_resposta,
 CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'protocolado' WHEN o_orderpriority = '1-URGENT' THEN 'cancelado' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'invalid' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS criado_em,
 o_orderdate + INTERVAL 2 DAY AS ultima_atualizacao, CASE WHEN o_orderstatus = 'F' THEN 'protocolado' ELSE 'revisar' END AS acao_usuario,
 CASE WHEN o_orderstatus = 'F' THEN 'Customer#' || lpad(CAST(o_custkey AS STRING),9,'0') ELSE NULL END AS usuario_protocolo,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY ELSE NULL END AS protocolado_em,
 CASE WHEN o_orderstatus = 'F' THEN 'recibo_' || CAST(o_orderkey AS STRING) || '.pdf' ELSE NULL END AS recibo_protocolo,
 CASE WHEN o_orderstatus = 'P' THEN 'motivo ' || o_orderpriority ELSE NULL END AS motivo_invalido,
 'obs ' || CAST(o_custkey AS STRING) AS observacao,
 CAST(NULL AS VARCHAR) AS hash_documento, CAST(NULL AS VARCHAR) AS hash_email
FROM orders WHERE o_orderkey % 7 <> 3"""
FIXTURE_SQL["respostas"] = """
SELECT o_orderkey + 2000000 AS id_resposta, o_orderkey AS id_email,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 10 + 1 END AS id_anexo,
 lpad(CAST(o_orderkey AS STRING),7,'0') || '-' || lpad(CAST(o_orderkey % 97 AS STRING),2,'0') || '.1998.8.26.' || lpad(CAST(o_custkey % 10000 AS STRING),4,'0') AS processo, CAST(o_custkey AS STRING) AS opaj, o_totalprice > 200000 AS validado,
 CASE WHEN o_totalprice > 200000 THEN 'protocolar' WHEN o_totalprice > 100000 THEN 'revisar' ELSE 'rejeitar' END AS acao_sugerida,
 CASE WHEN o_totalprice > 200000 THEN 'protocolar' ELSE '' END AS status_validacao,
 CASE WHEN o_orderkey % 2 = 0 THEN 'RESPOSTA FINAL' ELSE 'RESPOSTA PARCIAL' END AS status_final,
 o_orderdate AS data_chegada, CAST(NULL AS VARCHAR) AS tipo_resposta, CAST(NULL AS VARCHAR) AS motivo_invalido
FROM orders WHERE o_orderkey % 5 <> 0"""
FIXTURE_SQL["validacoes"] = """
SELECT event_id AS id_validacao, 2000000 + user_id AS id_resposta, ts AS data_validacao, event_type AS resultado FROM events"""
FIXTURE_SQL["usuarios"] = """
SELECT c_name AS username, c_name AS nome, lower(c_mktsegment) AS perfil, c_acctbal > 0 AS ativo FROM customer"""
FIXTURE_SQL["ia_respostas"] = """
SELECT event_id AS id_email, CASE CAST(event_id % 5 AS INT)
 WHEN 0 THEN '```json' || chr(10) || '{"valido": true, "campos_faltantes": [], "coerencia": true, "motivo": "ok", "acao_sugerida": "protocolar"}' || chr(10) || '```'
 WHEN 1 THEN '{"valido": false, "campos_faltantes": ["minuta"], "coerencia": false, "motivo": "sem minuta", "acao_sugerida": "rejeitar"}'
 WHEN 2 THEN 'Desculpe, nao posso.' WHEN 3 THEN '{"valido": false, "motivo": "parcial"}' ELSE '```' || chr(10) || '{"valido": true}' || chr(10) || '```' END AS conteudo FROM events"""
FIXTURE_SQL["divergencias"] = """
SELECT event_id AS id_divergencia, 1000000 + event_id AS id_protocolo, 'Customer#' || lpad(CAST(user_id AS STRING),9,'0') AS usuario, 'motivo ' || CAST(user_id % 7 AS STRING) AS motivo_manual, '' AS observacao, ts AS data_registro FROM events WHERE event_type = 'error'"""
FIXTURE_SQL["captura"] = """
SELECT event_id AS seq, '<' || CAST(user_id AS STRING) || '-' || event_type || '@fixture.example>' AS message_id, CASE WHEN user_id % 5 = 0 THEN 'Outro@example.com' ELSE 'Respostas@Example.com' END AS remetente, ts AS recebido_em, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '  curto  ' ELSE 'corpo da mensagem ' || CAST(event_id AS STRING) || ' com texto suficiente' END AS corpo_email, CAST(event_id % 4 AS INT) AS n_anexos FROM events"""
FIXTURE_SQL["captura_anexos"] = """
SELECT seq, parte, 'anexo_' || CAST(parte AS STRING) || '.pdf' AS nome_arquivo, 'application/pdf' AS tipo_arquivo,
 CAST(CASE WHEN (seq + parte) % 5 = 0 THEN 0 ELSE 10 + parte END AS INT) AS tamanho
FROM (SELECT seq, CAST(unnest(generate_series(1, n_anexos)) AS INT) AS parte FROM captura WHERE n_anexos > 0) x"""
FIXTURE_SQL["filing_requests"] = """
SELECT 1000000 + event_id AS id_protocolo, 'Customer#' || lpad(CAST(user_id AS STRING),9,'0') AS usuario,
 'recibo_' || CAST(event_id AS STRING) || '.pdf' AS nome_recibo, 'filed ' || CAST(user_id AS STRING) AS observacao,
 ts AS solicitado_em, event_id AS seq FROM events WHERE event_type = 'purchase'"""
FIXTURE_SQL["controle_pipeline"] = """
SELECT 'pausar_' || CAST(c_custkey AS STRING) AS chave, 'false' AS valor FROM customer WHERE c_acctbal > 0"""
FIXTURE_SQL["flag_commands"] = """
SELECT 'pausar_' || CAST(user_id AS STRING) AS chave, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS valor,
 ts AS emitido_em, event_id AS seq FROM events"""
FIXTURE_SQL["download_requests"] = """
SELECT event_id AS id_pedido, event_id * 10 + user_id % 7 + 1 AS id_anexo FROM events"""
FIXTURE_SQL["divergence_reports"] = """
SELECT event_id AS id_divergencia, 1000000 + event_id AS id_protocolo,
 CASE WHEN user_id % 10 = 0 THEN '' ELSE 'Customer#' || lpad(CAST(user_id AS STRING),9,'0') END AS usuario,
 CASE WHEN user_id % 13 = 0 THEN '' ELSE 'motivo ' || CAST(user_id % 7 AS STRING) END AS motivo_manual,
 '' AS observacao, ts AS data_registro FROM events WHERE event_type = 'view'"""

_DEPENDS = {"emails": ["emails0"], "captura_anexos": ["captura"]}

AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"
SENDER = "respostas@example.com"


def with_fixtures(sql: str) -> str:
    """Prepend the fixture views that ``sql`` references as CTEs."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in FIXTURE_SQL:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    order = [n for n in FIXTURE_SQL if n in needed]
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in order)
    return f"WITH {ctes}\nSELECT * FROM (\n{sql}\n) AS q"


# -- shared SQL fragments ----------------------------------------------------------
BOARD_PAGE = """
 SELECT e.id_email, e.assunto, e.recebido_em, e.tipo_email, e.corpo_email,
        p.id_protocolo, p.id_resposta, p.status, p.acao_usuario, p.observacao, p.criado_em,
        p.ultima_atualizacao, r.tipo_resposta, r.processo, r.opaj, r.status_final, r.acao_sugerida
 FROM emails e LEFT JOIN protocolos p ON p.id_email = e.id_email
 LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
 WHERE {where}
 ORDER BY COALESCE(p.criado_em, e.recebido_em) DESC NULLS FIRST, e.id_email ASC NULLS FIRST,
          p.id_protocolo ASC NULLS FIRST
 {limit}"""


def board(where: str = "e.tipo_email = 'protocolo'", limit: str = "LIMIT 100") -> str:
    return BOARD_PAGE.format(where=where, limit=limit)


TEXT = "(coalesce(assunto,'') || ' ' || coalesce(corpo_email,''))"
CNJ = r"\d{7}-\d{2}(?:\.\d{4})?\.\d(?:\.\d{2})?\.\d{4}|\d{20}"
DIGITS = r"\d{6,25}"
OPAJ = r"(?i)OPAJ[-–:/\s]*([0-9]+)"
IDENT = r"(?i)\b(FNDA|DILA)[-–:/\s]?(\d{6,})\b"
STATUS = r"(?i)(RESPOSTA FINAL|RESPOSTA PARCIAL|DILAÇÃO|RESPOSTA MONITORAMENTO)"


def case_number_sql(t: str) -> str:
    return (f"coalesce(NULLIF(regexp_extract({t}, '{CNJ}', 0), ''), "
            f"NULLIF(regexp_extract({t}, '{DIGITS}', 0), ''))")


def opaj_sql(t: str) -> str:
    return f"NULLIF(regexp_extract({t}, '{OPAJ}', 1), '')"


def ident_sql(t: str) -> str:
    return (f"CASE WHEN regexp_extract({t}, '{IDENT}', 1) <> '' THEN "
            f"upper(regexp_extract({t}, '{IDENT}', 1)) || '-' || regexp_extract({t}, '{IDENT}', 2) END")


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


# Backlog requests: backlog mails with names and extracted fields.
REQUESTS = f"""
 SELECT e.*, n.nomes_texto, coalesce(n.nomes_lista, []) AS nomes_lista,
        {case_number_sql(TEXT)} AS processo, {opaj_sql(TEXT)} AS opaj, {ident_sql(TEXT)} AS identificador
 FROM emails e
 LEFT JOIN (SELECT id_email, string_agg(nome_arquivo, ', ' ORDER BY id_anexo) AS nomes_texto,
                   list(nome_arquivo ORDER BY id_anexo) AS nomes_lista
            FROM anexos_email GROUP BY id_email) n ON n.id_email = e.id_email
 WHERE e.tipo_email = 'protocolo' AND NOT EXISTS (SELECT 1 FROM protocolos p WHERE p.id_email = e.id_email)"""

# Parsed verdict text (F17) per id_email.
_S0 = strip_sql("conteudo")
_S2 = f"regexp_replace(regexp_replace({_S0}, '^```json\\s*', ''), '\\s*```$', '')"
PARSED = f"""
 SELECT id_email, s, ok,
   CASE WHEN ok THEN TRY_CAST(json_extract(s, '$.valido') AS BOOLEAN) END AS valido,
   CASE WHEN ok THEN TRY_CAST(json_extract(s, '$.coerencia') AS BOOLEAN) END AS coerencia,
   CASE WHEN ok THEN json_extract_string(s, '$.motivo') ELSE 'IA não respondeu em JSON válido. Conteúdo bruto: ' || s END AS motivo,
   CASE WHEN ok THEN json_extract_string(s, '$.acao_sugerida') ELSE 'aguardar' END AS acao_sugerida,
   CASE WHEN ok THEN json_extract_string(s, '$.erro_ia') ELSE 'json_decode_error' END AS erro_ia,
   CASE WHEN ok THEN coalesce(TRY_CAST(json_extract(s, '$.campos_faltantes') AS VARCHAR[]), []) ELSE [] END AS faltantes_lista
 FROM (SELECT id_email, s, coalesce(json_valid(s), false) AND s LIKE '{{%' AS ok
       FROM (SELECT id_email, {_S2} AS s FROM ia_respostas) a) b"""

ROUTED = f"""
 SELECT q.*, v.valido, v.coerencia, v.motivo, v.acao_sugerida, v.faltantes_lista,
   CASE WHEN coalesce(v.valido, false) THEN 'pending' ELSE 'invalid' END AS status,
   CASE WHEN coalesce(v.valido, false) THEN NULL ELSE v.motivo END AS motivo_invalido
 FROM ({REQUESTS}) q JOIN ({PARSED}) v ON v.id_email = q.id_email"""

NEW_CAPTURE = r"""
 SELECT c.message_id, c.seq, coalesce(NULLIF(regexp_extract(c.remetente, '<([^<>]*)>', 1), ''), trim(c.remetente)) AS remetente,
        c.recebido_em, regexp_replace(c.corpo_email, '^\s+|\s+$', '', 'g') AS corpo_email, c.n_anexos
 FROM captura c
 JOIN (SELECT message_id, min(seq) AS seq FROM captura
       WHERE lower(coalesce(NULLIF(regexp_extract(remetente, '<([^<>]*)>', 1), ''), trim(remetente))) = 'respostas@example.com'
       GROUP BY message_id) f ON f.message_id = c.message_id AND f.seq = c.seq
 WHERE c.message_id NOT IN (SELECT message_id FROM emails)"""

COMPLETENESS_FLAGS = """
 SELECT id_email,
   max(CASE WHEN lower(coalesce(nome_arquivo,'')) LIKE '%minuta%' OR lower(coalesce(nome_arquivo,'')) LIKE '%resposta%' OR lower(coalesce(nome_arquivo,'')) LIKE '%oficio%' THEN 1 ELSE 0 END) AS d,
   max(CASE WHEN lower(coalesce(nome_arquivo,'')) LIKE '%minuta%' THEN 1 ELSE 0 END) AS mi,
   max(CASE WHEN lower(coalesce(nome_arquivo,'')) LIKE '%assinatura%' OR lower(coalesce(nome_arquivo,'')) LIKE '%certificado%' THEN 1 ELSE 0 END) AS sg,
   max(CASE WHEN lower(coalesce(nome_arquivo,'')) LIKE '%bloqueio%' THEN 1 ELSE 0 END) AS bq,
   sum(CASE WHEN lower(coalesce(nome_arquivo,'')) LIKE '%minuta%' OR lower(coalesce(nome_arquivo,'')) LIKE '%assinatura%' OR lower(coalesce(nome_arquivo,'')) LIKE '%certificado%' THEN 0 ELSE 1 END) AS outros
 FROM anexos_email GROUP BY id_email"""

MISSING = """concat_ws(',',
   CASE WHEN coalesce(f.d,0) = 0 THEN 'minuta' END,
   CASE WHEN coalesce(f.sg,0) = 0 THEN 'assinatura' END,
   CASE WHEN (lower(coalesce(x.assunto,'')) || chr(10) || lower(coalesce(x.corpo_email,''))) LIKE '%bloqueio%' AND coalesce(f.bq,0) = 0 THEN 'bloqueio' END)"""

RESP_COLS = ("id_resposta, id_email, id_anexo, tipo_resposta, processo, opaj, identificador, status, "
             "status_validacao, status_final, acao_sugerida, motivo_invalido, resumo_ia, observacao, "
             "coerente, validado, erros, nomes_anexos, data_chegada")

PROTO_COLS = ("id_protocolo, id_email, id_resposta, status, acao_usuario, usuario_protocolo, "
              "recibo_protocolo, motivo_invalido, observacao, hash_documento, hash_email, criado_em, "
              "ultima_atualizacao, protocolado_em")

SQL: dict[str, str] = {}

SQL["case_board_attachments"] = f"""
SELECT page.*, a.id_anexo, a.nome_arquivo, a.tipo_arquivo
FROM ({board()}) page LEFT JOIN anexos_email a ON a.id_email = page.id_email"""

SQL["case_board"] = f"""
SELECT page.*, coalesce(c.n_anexos, 0) AS n_anexos
FROM ({board()}) page
LEFT JOIN (SELECT id_email, count(*) AS n_anexos FROM anexos_email GROUP BY id_email) c ON c.id_email = page.id_email"""

SQL["board_by_date"] = board("e.tipo_email = 'protocolo' AND CAST(e.recebido_em AS DATE) = DATE '1996-03-15'")
SQL["board_by_action"] = board("e.tipo_email = 'protocolo' AND r.acao_sugerida = 'revisar'")
SQL["board_by_status"] = board("e.tipo_email = 'protocolo' AND p.status = 'invalid'")

SQL["board_facets"] = f"""
SELECT DISTINCT faceta, valor,
  CASE WHEN faceta = 'tipo_email' THEN upper(substr(valor, 1, 1)) || substr(valor, 2) ELSE valor END AS rotulo
FROM (SELECT 'acao_sugerida' AS faceta, acao_sugerida AS valor FROM ({board()}) b1
      UNION ALL SELECT 'tipo_email' AS faceta, tipo_email AS valor FROM ({board()}) b2) u
WHERE valor IS NOT NULL AND valor <> ''"""

SQL["board_count"] = f"SELECT count(*) AS total FROM ({board(limit='')}) b"

SQL["validation_backlog"] = """
SELECT e.* FROM emails e LEFT JOIN protocolos p ON e.id_email = p.id_email
WHERE p.id_email IS NULL AND e.tipo_email = 'protocolo'"""

SQL["pending_count"] = """
SELECT COUNT(DISTINCT p.id_protocolo) AS total FROM protocolos p JOIN emails e ON e.id_email = p.id_email
WHERE e.tipo_email = 'protocolo' AND p.status NOT IN ('protocolado', 'cancelado')"""

SQL["pending_count_by_status"] = """
SELECT COUNT(DISTINCT p.id_protocolo) AS total FROM protocolos p JOIN emails e ON e.id_email = p.id_email
WHERE e.tipo_email = 'protocolo' AND p.status = 'protocolado'"""

LISTING = """
SELECT p.id_protocolo, p.id_email, p.id_resposta, p.status, p.acao_usuario, p.hash_documento, p.hash_email,
       p.observacao, p.motivo_invalido AS motivo_invalido_protocolo, p.criado_em, p.ultima_atualizacao,
       e.assunto, e.remetente, e.recebido_em, e.corpo_email, e.tipo_email,
       r.tipo_resposta, r.processo, r.opaj, r.status_final, r.acao_sugerida, r.status_validacao, r.motivo_invalido,
       a.id_anexo, a.nome_arquivo, a.tipo_arquivo,
       coalesce(a.nome_arquivo LIKE '%.zip', false) AS tem_zip, coalesce(a.nome_arquivo LIKE '%.pdf', false) AS tem_pdf
FROM protocolos p JOIN emails e ON e.id_email = p.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
LEFT JOIN anexos_email a ON a.id_email = p.id_email
WHERE {where}
ORDER BY p.criado_em DESC NULLS FIRST, p.id_protocolo ASC NULLS FIRST, a.id_anexo ASC NULLS FIRST
LIMIT 200"""
SQL["protocol_listing"] = LISTING.format(where="e.tipo_email = 'protocolo'")
SQL["optional_filters"] = LISTING.format(where="TRUE")

SQL["communications"] = """
SELECT id_email, assunto, remetente, recebido_em, tipo_email, corpo_email FROM emails
WHERE tipo_email <> 'protocolo' ORDER BY recebido_em DESC NULLS FIRST, id_email ASC NULLS FIRST LIMIT 200"""

SQL["report_range"] = f"""
SELECT p.*, e.assunto, e.remetente, e.recebido_em, e.tipo_email, r.tipo_resposta, r.processo, r.opaj
FROM protocolos p JOIN emails e ON e.id_email = p.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
WHERE e.tipo_email = 'protocolo' AND CAST(e.recebido_em AS DATE) >= DATE '1996-01-01'
  AND CAST(e.recebido_em AS DATE) <= DATE '1996-12-31'
ORDER BY p.criado_em DESC NULLS FIRST, p.id_protocolo"""

SQL["case_flat_detail"] = """
SELECT p.*, e.assunto, e.remetente, e.corpo_email, e.recebido_em,
       r.tipo_resposta AS resposta_tipo_resposta, r.processo AS resposta_processo, r.opaj AS resposta_opaj,
       r.status_final AS resposta_status_final, r.acao_sugerida AS resposta_acao_sugerida,
       r.status_validacao AS resposta_status_validacao, r.motivo_invalido AS resposta_motivo_invalido,
       a.id_anexo AS anexo_id, a.nome_arquivo AS anexo_nome_arquivo, a.tipo_arquivo AS anexo_tipo_arquivo
FROM protocolos p JOIN emails e ON e.id_email = p.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
LEFT JOIN (SELECT id_email, min(id_anexo) AS id_anexo FROM anexos_email GROUP BY id_email) f ON f.id_email = p.id_email
LEFT JOIN anexos_email a ON a.id_anexo = f.id_anexo
WHERE p.id_protocolo IN (SELECT id_protocolo FROM divergencias)"""

SQL["case_detail"] = """
SELECT e.id_email, e.assunto, e.remetente, e.recebido_em, e.tipo_email,
  coalesce((SELECT count(*) FROM respostas r WHERE r.id_email = e.id_email), 0) AS n_respostas,
  coalesce((SELECT count(*) FROM anexos_email a WHERE a.id_email = e.id_email), 0) AS n_anexos,
  coalesce((SELECT count(*) FROM protocolos p WHERE p.id_email = e.id_email), 0) AS n_protocolos,
  (SELECT p.status FROM protocolos p WHERE p.id_email = e.id_email
    ORDER BY p.criado_em DESC NULLS LAST, p.id_protocolo DESC LIMIT 1) AS status_recente
FROM emails e"""

SQL["filed_cases"] = """
SELECT p.id_protocolo, p.id_email, p.id_resposta, p.protocolado_em, p.usuario_protocolo, p.recibo_protocolo,
       e.assunto, e.remetente, e.recebido_em, r.status_final,
       coalesce((SELECT count(*) FROM anexos_email a WHERE a.id_email = p.id_email), 0) AS n_anexos
FROM protocolos p JOIN emails e ON e.id_email = p.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
WHERE p.acao_usuario = 'protocolado'"""

SQL["reported_cases"] = """
SELECT d.id_divergencia, d.id_protocolo, d.usuario, d.motivo_manual, d.observacao AS observacao_divergencia,
       d.data_registro, p.id_email, p.id_resposta, p.status, e.assunto, e.remetente, e.recebido_em, r.status_final,
       coalesce((SELECT count(*) FROM anexos_email a WHERE a.id_email = p.id_email), 0) AS n_anexos
FROM divergencias d JOIN protocolos p ON p.id_protocolo = d.id_protocolo
JOIN emails e ON e.id_email = p.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta"""

SQL["attachment_names"] = """
SELECT id_email, string_agg(nome_arquivo, ', ' ORDER BY id_anexo) AS nomes_texto, count(*) AS n_anexos
FROM anexos_email GROUP BY id_email"""

SQL["attachment_flags"] = """
SELECT id_anexo, id_email, nome_arquivo, coalesce(nome_arquivo LIKE '%.zip', false) AS tem_zip,
       coalesce(nome_arquivo LIKE '%.pdf', false) AS tem_pdf FROM anexos_email"""

SQL["attachment_lookup"] = """
SELECT q.id_anexo, a.nome_arquivo, coalesce(NULLIF(a.tipo_arquivo, ''), 'application/octet-stream') AS tipo_arquivo,
       CAST(coalesce(length(c.conteudo), 0) AS INTEGER) AS tamanho,
       CASE WHEN a.id_anexo IS NULL THEN 'anexo_nao_encontrado'
            WHEN coalesce(length(c.conteudo), 0) = 0 THEN 'conteudo_vazio' ELSE 'ok' END AS resultado
FROM (SELECT DISTINCT id_anexo FROM download_requests) q
LEFT JOIN anexos_email a ON a.id_anexo = q.id_anexo
LEFT JOIN anexos_conteudo c ON c.id_anexo = q.id_anexo"""

SQL["reply_by_attachment"] = """
SELECT q.id_anexo, r.id_resposta FROM download_requests q
LEFT JOIN (SELECT id_anexo, min(id_resposta) AS id_resposta FROM respostas WHERE id_anexo IS NOT NULL GROUP BY id_anexo) r
  ON r.id_anexo = q.id_anexo"""

SQL["fileable_cases"] = """
SELECT id_protocolo, status, coalesce(status IN ('pending', 'invalid', 'incompleto', 'revisao'), false) AS pode_protocolar
FROM protocolos"""

SQL["status_labels"] = """
SELECT id_protocolo, status, coalesce(CASE status WHEN 'pending' THEN 'Pendente' WHEN 'protocolado' THEN 'Protocolado'
  WHEN 'invalid' THEN 'Inválido IA' WHEN 'incompleto' THEN 'Incompleto' WHEN 'reportado' THEN 'Reportado'
  WHEN 'revisao' THEN 'Em Revisão' WHEN 'completed' THEN 'Concluído' END, status) AS rotulo
FROM protocolos"""

SQL["active_users"] = "SELECT username, nome, perfil FROM usuarios WHERE ativo"

SQL["known_user_filings"] = """
SELECT usuario_protocolo, id_protocolo, id_email, protocolado_em FROM protocolos
WHERE usuario_protocolo IS NOT NULL AND usuario_protocolo IN (SELECT username FROM usuarios WHERE ativo)"""

SQL["pending_panel"] = """
SELECT e.id_email, p.id_protocolo,
  coalesce(NULLIF(p.id_resposta, 0), NULLIF(p.id_protocolo, 0), NULLIF(e.id_email, 0)) AS id_exibicao,
  substr(e.assunto, 1, 80) AS assunto_curto,
  strftime(coalesce(r.data_chegada, p.criado_em), '%d/%m/%Y, %H:%M:%S') AS chegada,
  coalesce(NULLIF(r.status_validacao, ''), NULLIF(p.status, ''), 'Aguardando') AS status_exibicao
FROM emails e JOIN protocolos p ON p.id_email = e.id_email
LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
WHERE e.tipo_email = 'protocolo' AND p.status NOT IN ('protocolado', 'cancelado')"""

SQL["extract_fields"] = f"""
SELECT id_email, {case_number_sql(TEXT)} AS processo, {opaj_sql(TEXT)} AS opaj, {ident_sql(TEXT)} AS identificador
FROM emails"""

SQL["extract_documents"] = f"""
SELECT doc_id, {case_number_sql('text')} AS processo, {opaj_sql('text')} AS opaj, {ident_sql('text')} AS identificador,
       sha256(text) AS hash_documento FROM documents"""

SQL["content_hash_groups"] = """
SELECT sha256(text) AS hash_documento, count(*) AS n_documentos, min(doc_id) AS primeiro_doc
FROM documents GROUP BY sha256(text) HAVING count(*) > 1"""

SQL["extract_subject_refs"] = f"""
SELECT id_email, {case_number_sql('assunto')} AS processo, {opaj_sql('assunto')} AS opaj,
  {ident_sql('assunto')} AS identificador,
  regexp_extract_all(upper(assunto), '{STATUS}', 1)[-1] AS status_final,
  CASE WHEN NULLIF(regexp_extract(assunto, '{CNJ}', 0), '') IS NOT NULL THEN 'CNJ'
       WHEN NULLIF(regexp_extract(assunto, '{DIGITS}', 0), '') IS NOT NULL THEN 'ADMINISTRATIVO' END AS tipo_processo
FROM emails"""

SQL["extract_strict"] = f"""
SELECT id_email, regexp_extract({TEXT}, '\\d{{7}}-\\d{{2}}\\.\\d{{4}}\\.\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}', 0) AS processo_estrito,
       regexp_extract({TEXT}, '\\b\\d{{7}}\\b', 0) AS opaj_estrito FROM emails"""

SQL["classify_mail"] = """
SELECT id_email, assunto, CASE
  WHEN contains(lower(coalesce(assunto,'')), 'ofício') OR contains(lower(coalesce(assunto,'')), 'resposta') THEN 'protocolo'
  WHEN contains(lower(coalesce(assunto,'')), 'cancelamento') OR contains(lower(coalesce(assunto,'')), 'desistência') THEN 'cancelamento'
  WHEN contains(lower(coalesce(assunto,'')), 'comunicação') OR contains(lower(coalesce(assunto,'')), 'comunicado') THEN 'comunicacao'
  ELSE 'outro' END AS tipo_classificado FROM emails"""

SQL["attachment_completeness"] = f"""
SELECT x.id_email, {MISSING} AS faltantes,
  CASE WHEN {MISSING} <> '' THEN 'incompleto' ELSE 'completo' END AS status_contexto
FROM emails x LEFT JOIN ({COMPLETENESS_FLAGS}) f ON f.id_email = x.id_email"""

SQL["received_time"] = f"""
SELECT seq, h AS cabecalho_data,
  coalesce(CASE WHEN regexp_full_match(substr(h, 1, 31), '[A-Za-z]{{3}}, \\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{1,2}}:\\d{{2}}:\\d{{2}} [+-]\\d{{4}}')
    THEN CAST(timezone('UTC', try_strptime(substr(h, 1, 31), '%a, %d %b %Y %H:%M:%S %z')) AS TIMESTAMP) END,
    {AS_OF}) AS recebido_em
FROM (SELECT seq, CASE WHEN seq % 9 = 0 THEN 'data invalida'
   WHEN seq % 9 = 1 THEN strftime(recebido_em, '%d %b %Y %H:%M:%S +0000')
   ELSE strftime(recebido_em, '%a, %d %b %Y %H:%M:%S -0300') END AS h FROM captura) c"""

SQL["verdict_prompt"] = f"""
SELECT id_email, substr(coalesce(corpo_email, ''), 1, 800) AS corpo_prompt, coalesce(nomes_texto, '') AS nomes_texto,
  CAST(json_object('processo', processo, 'opaj', opaj, 'identificador', identificador) AS VARCHAR) AS campos_json,
  'Valide a resposta ao ofício.' || chr(10) || 'Assunto: ' || coalesce(assunto, '') || chr(10) || 'Corpo: ' ||
  substr(coalesce(corpo_email, ''), 1, 800) || chr(10) || 'Anexos: ' || coalesce(nomes_texto, '') || chr(10) ||
  'Campos: ' || CAST(json_object('processo', processo, 'opaj', opaj, 'identificador', identificador) AS VARCHAR) || chr(10) ||
  'Responda em JSON com valido, campos_faltantes, coerencia, motivo, acao_sugerida.' AS prompt
FROM ({REQUESTS}) q"""

SQL["verdict_parse"] = f"""
SELECT id_email, valido, coerencia, motivo, acao_sugerida, erro_ia,
  array_to_string(faltantes_lista, ',') AS faltantes, CAST(len(faltantes_lista) AS INTEGER) AS n_faltantes
FROM ({PARSED}) v"""

SQL["verdict_routing"] = f"""
SELECT id_email, status, motivo_invalido, motivo AS observacao, acao_sugerida AS tipo_resposta,
  acao_sugerida AS status_validacao, valido AS validado, processo, opaj, identificador
FROM ({ROUTED}) r"""

SQL["formal_rules"] = f"""
SELECT id_email, acao AS acao_sugerida, acao = 'protocolar' AS valido, ids_ok AND mention_ok AS coerencia,
  CASE WHEN motivos = '' THEN 'regras formais atendidas' ELSE motivos END AS motivo, faltantes
FROM (
 SELECT id_email, acao, ids_ok, mention_ok, faltantes,
   concat_ws('; ', CASE WHEN NOT draft THEN 'minuta ausente' END,
                   CASE WHEN NOT sig THEN 'comprovante de assinatura ausente' END,
                   CASE WHEN NOT ids_ok THEN 'identificadores divergentes' END,
                   CASE WHEN NOT mention_ok THEN 'anexo mencionado ausente' END) AS motivos
 FROM (
  SELECT id_email, draft, sig, ids_ok, mention_ok, faltantes,
    CASE WHEN NOT draft AND NOT sig THEN 'rejeitar' WHEN draft AND sig AND ids_ok AND mention_ok THEN 'protocolar'
         ELSE 'revisar' END AS acao
  FROM (
   SELECT x.id_email, coalesce(f.mi, 0) = 1 AS draft, coalesce(f.sg, 0) = 1 AS sig,
     (x.processo IS NULL OR contains(x.hay, lower(x.processo))) AND (x.opaj IS NULL OR contains(x.hay, lower(x.opaj)))
       AND (x.identificador IS NULL OR contains(x.hay, lower(x.identificador))) AS ids_ok,
     NOT (contains(lower(coalesce(x.corpo_email, '')), 'segue anexo') OR contains(lower(coalesce(x.corpo_email, '')), 'documento em anexo'))
       OR coalesce(f.outros, 0) > 0 AS mention_ok,
     {MISSING} AS faltantes
   FROM (SELECT q.*, lower(coalesce(assunto, '') || chr(10) || coalesce(corpo_email, '') || chr(10) || coalesce(nomes_texto, '')) AS hay
         FROM ({REQUESTS}) q) x
   LEFT JOIN ({COMPLETENESS_FLAGS}) f ON f.id_email = x.id_email) a) b) c"""

SQL["reply_upsert"] = f"""
WITH src AS (
  SELECT id_email, acao_sugerida AS tipo_resposta, processo, opaj, coerencia AS coerente,
    array_to_string(faltantes_lista, ',') AS erros, identificador, status, acao_sugerida AS status_validacao,
    valido AS validado, array_to_string(nomes_lista, ',') AS nomes_anexos, motivo AS resumo_ia, motivo AS observacao,
    {AS_OF} AS data_chegada
  FROM ({ROUTED}) r)
SELECT coalesce(t.id_resposta, 2000000 + s.id_email) AS id_resposta, coalesce(t.id_email, s.id_email) AS id_email,
  t.id_anexo,
  CASE WHEN s.id_email IS NOT NULL THEN s.tipo_resposta ELSE t.tipo_resposta END AS tipo_resposta,
  CASE WHEN s.id_email IS NOT NULL THEN s.processo ELSE t.processo END AS processo,
  CASE WHEN s.id_email IS NOT NULL THEN s.opaj ELSE t.opaj END AS opaj,
  CASE WHEN s.id_email IS NOT NULL THEN s.identificador END AS identificador,
  CASE WHEN s.id_email IS NOT NULL THEN s.status END AS status,
  CASE WHEN s.id_email IS NOT NULL THEN s.status_validacao ELSE t.status_validacao END AS status_validacao,
  t.status_final, t.acao_sugerida, t.motivo_invalido,
  CASE WHEN s.id_email IS NOT NULL THEN s.resumo_ia END AS resumo_ia,
  CASE WHEN s.id_email IS NOT NULL THEN s.observacao END AS observacao,
  CASE WHEN s.id_email IS NOT NULL THEN s.coerente END AS coerente,
  CASE WHEN s.id_email IS NOT NULL THEN s.validado ELSE t.validado END AS validado,
  CASE WHEN s.id_email IS NOT NULL THEN s.erros END AS erros,
  CASE WHEN s.id_email IS NOT NULL THEN s.nomes_anexos END AS nomes_anexos,
  CASE WHEN s.id_email IS NOT NULL THEN s.data_chegada ELSE t.data_chegada END AS data_chegada
FROM respostas t FULL OUTER JOIN src s ON t.id_email = s.id_email"""

SQL["protocol_append"] = f"""
SELECT 1000000 + id_email AS id_protocolo, id_email, CAST(NULL AS BIGINT) AS id_resposta, status,
  acao_sugerida AS acao_usuario, CAST(NULL AS VARCHAR) AS usuario_protocolo, CAST(NULL AS VARCHAR) AS recibo_protocolo,
  motivo_invalido, motivo AS observacao, identificador AS hash_documento, CAST(NULL AS VARCHAR) AS hash_email,
  {AS_OF} AS criado_em, {AS_OF} AS ultima_atualizacao, CAST(NULL AS TIMESTAMP) AS protocolado_em
FROM ({ROUTED}) r WHERE id_email NOT IN (SELECT id_email FROM protocolos)"""

SQL["control_flag_upsert"] = """
WITH last AS (
  SELECT chave, valor FROM (SELECT *, row_number() OVER (PARTITION BY chave ORDER BY emitido_em DESC, seq DESC) AS rn
                            FROM flag_commands) x WHERE rn = 1)
SELECT t.chave, CASE WHEN l.chave IS NOT NULL THEN l.valor ELSE t.valor END AS valor
FROM controle_pipeline t LEFT JOIN last l ON l.chave = t.chave
UNION ALL
SELECT l.chave, l.valor FROM last l WHERE l.valor = 'true' AND l.chave NOT IN (SELECT chave FROM controle_pipeline)"""

SQL["filing_update"] = f"""
WITH req AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_protocolo ORDER BY solicitado_em DESC, seq DESC) AS rn
                 FROM filing_requests) x WHERE rn = 1)
SELECT p.id_protocolo, p.id_email, p.id_resposta, p.status,
  CASE WHEN q.id_protocolo IS NOT NULL THEN 'protocolado' ELSE p.acao_usuario END AS acao_usuario,
  CASE WHEN q.id_protocolo IS NOT NULL THEN q.usuario ELSE p.usuario_protocolo END AS usuario_protocolo,
  CASE WHEN q.id_protocolo IS NOT NULL THEN q.nome_recibo ELSE p.recibo_protocolo END AS recibo_protocolo,
  p.motivo_invalido,
  CASE WHEN q.id_protocolo IS NOT NULL THEN q.observacao ELSE p.observacao END AS observacao,
  p.hash_documento, p.hash_email, p.criado_em, p.ultima_atualizacao,
  CASE WHEN q.id_protocolo IS NOT NULL THEN q.solicitado_em ELSE p.protocolado_em END AS protocolado_em
FROM protocolos p LEFT JOIN req q ON q.id_protocolo = p.id_protocolo"""

SQL["divergence_append"] = """
SELECT id_divergencia, id_protocolo, coalesce(NULLIF(usuario, ''), 'usuario') AS usuario, motivo_manual, observacao,
  data_registro FROM divergence_reports WHERE length(trim(coalesce(motivo_manual, ''))) > 0"""

SQL["validation_history"] = """
SELECT id_validacao, id_resposta, data_validacao, resultado,
  row_number() OVER (PARTITION BY id_resposta ORDER BY data_validacao DESC, id_validacao DESC) AS posicao
FROM validacoes"""

SQL["validation_latest"] = """
SELECT id_resposta, id_validacao, data_validacao, resultado FROM (
  SELECT *, row_number() OVER (PARTITION BY id_resposta ORDER BY data_validacao DESC, id_validacao DESC) AS rn
  FROM validacoes) x WHERE rn = 1"""

SQL["sender_filter"] = r"""
SELECT seq, message_id, remetente FROM captura
WHERE lower(coalesce(NULLIF(regexp_extract(remetente, '<([^<>]*)>', 1), ''), trim(remetente))) = 'respostas@example.com'"""

SQL["capture_new_messages"] = NEW_CAPTURE

SQL["capture_emails"] = f"SELECT n.*, md5(n.message_id) AS id_email FROM ({NEW_CAPTURE}) n"

SQL["capture_attachments"] = f"""
SELECT n.seq, n.message_id, md5(n.message_id) AS id_email, a.parte, a.nome_arquivo, a.tipo_arquivo, a.tamanho
FROM ({NEW_CAPTURE}) n JOIN captura_anexos a ON a.seq = n.seq WHERE a.tamanho > 0"""

SQL["capture_quality_failures"] = f"""
SELECT seq, message_id, md5(message_id) AS id_email, st AS tipo_resposta, st AS status, 'erro' AS status_validacao, false AS validado,
  CASE WHEN st = 'sem_anexo' THEN 'E-mail sem anexo. Não é possível realizar análise completa.'
       ELSE 'Corpo da mensagem está vazio ou fora do padrão esperado.' END AS erros,
  recebido_em AS data_chegada
FROM (SELECT n.*, CASE WHEN coalesce(k.n, 0) = 0 THEN 'sem_anexo'
        WHEN n.corpo_email IS NULL OR length(regexp_replace(n.corpo_email, '^\\s+|\\s+$', '', 'g')) < 20 THEN 'fora_do_padrao'
        END AS st
      FROM ({NEW_CAPTURE}) n
      LEFT JOIN (SELECT seq, count(*) AS n FROM captura_anexos WHERE tamanho > 0 GROUP BY seq) k ON k.seq = n.seq) x
WHERE st IS NOT NULL"""

ACCEPTED = ("lower(coalesce(NULLIF(regexp_extract(remetente, '<([^<>]*)>', 1), ''), trim(remetente)))"
            " = 'respostas@example.com'")

SQL["capture_summary"] = f"""
SELECT s.salvos, a.acc - s.salvos AS duplicados, CAST(0 AS BIGINT) AS falhas, a.total - a.acc AS ignorados
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {ACCEPTED}) AS acc FROM captura) a,
     (SELECT count(*) AS salvos FROM ({NEW_CAPTURE}) n) s"""

OUTCOMES = f"""
SELECT c.seq, c.message_id,
  CASE WHEN NOT coalesce({ACCEPTED.replace('remetente', 'c.remetente')}, false) THEN 'ignorado'
       WHEN c.message_id IN (SELECT message_id FROM emails) OR c.seq <> f.first_seq THEN 'duplicado'
       ELSE 'salvo' END AS resultado
FROM captura c LEFT JOIN (SELECT message_id, min(seq) AS first_seq FROM captura WHERE {ACCEPTED} GROUP BY message_id) f
  ON f.message_id = c.message_id"""

SQL["capture_outcomes"] = OUTCOMES

SQL["capture_progress"] = f"""
SELECT count(*) AS total, CAST(greatest(count(resultado) - 1, 0) AS BIGINT) AS atual,
  count(resultado) = count(*) AS finalizado FROM ({OUTCOMES}) o"""

SQL["mail_parse"] = """
SELECT 'mail/' || CAST(c.seq AS VARCHAR) || '.eml' AS path, c.message_id, c.remetente,
  CASE WHEN c.seq % 2 = 0 THEN 'Resposta de Ofício nº ' || CAST(c.seq AS VARCHAR) ELSE 'Resposta ' || CAST(c.seq AS VARCHAR) END AS assunto,
  regexp_replace(c.corpo_email, '^\\s+|\\s+$', '', 'g') AS corpo_email,
  CAST(c.n_anexos AS INTEGER) AS n_partes,
  CAST((SELECT count(*) FROM captura_anexos a WHERE a.seq = c.seq AND a.tamanho > 0) AS INTEGER) AS n_anexos_salvos
FROM captura c"""

SQL["stream_capture"] = NEW_CAPTURE
SQL["stream_validation"] = SQL["protocol_append"]


def oracle_sql() -> dict[str, str]:
    return {name: with_fixtures(sql) for name, sql in SQL.items()}
