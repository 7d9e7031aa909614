"""Oracle SQL of ``workflow_queries`` (DuckDB), over the fixture views of ``oracle``."""

from __future__ import annotations

from . import oracle as O

SQL: dict[str, str] = {}

# -- capture of raw mail: one pass over the messages in mailbox order ------------------
_LANDED = """
 SELECT seq, lote, remetente, assunto, recebido_em, falha, CASE WHEN falha THEN NULL ELSE corpo END AS corpo_email,
        coalesce(mid, '<hash-' || sha256(concat_ws(chr(31), remetente, assunto, strftime(recebido_em, '%Y-%m-%d %H:%M:%S'),
                 coalesce(CASE WHEN falha THEN NULL ELSE corpo END, chr(0)))) || '>') AS message_id
 FROM (SELECT seq, CAST(floor(seq * 3 / ((SELECT max(seq) FROM captura) + 1)) AS BIGINT) AS lote,
              CASE WHEN seq % 17 = 3 THEN NULL ELSE message_id END AS mid, remetente,
              CASE WHEN seq % 2 = 0 THEN 'Resposta de Ofício nº ' || seq ELSE 'Resposta ' || seq END AS assunto,
              date_trunc('second', recebido_em) AS recebido_em,
              regexp_replace(corpo_email, '^\\s+|\\s+$', '', 'g') AS corpo,
              (seq % 23 = 5 AND corpo_email IS NOT NULL) AS falha
       FROM captura) a"""
_PASS = f"""
 SELECT m.*, CASE WHEN lower(m.remetente) <> 'respostas@example.com' THEN 'ignorado'
   WHEN m.message_id IN (SELECT message_id FROM emails) OR m.seq > f.primeiro THEN 'duplicado'
   WHEN m.falha THEN 'falha' ELSE 'salvo' END AS resultado, md5(m.message_id) AS id_email
 FROM ({_LANDED}) m LEFT JOIN (SELECT message_id, min(seq) AS primeiro FROM ({_LANDED}) x
   WHERE lower(remetente) = 'respostas@example.com' AND NOT falha GROUP BY message_id) f ON f.message_id = m.message_id"""

SQL["raw_capture_emails"] = f"""
SELECT lote, id_email, message_id, remetente, assunto, recebido_em, corpo_email, 'protocolo' AS tipo_email
FROM ({_PASS}) p WHERE resultado = 'salvo'"""

SQL["raw_capture_attachments"] = f"""
SELECT p.lote, md5(p.message_id || '#' || a.parte) AS id_anexo, p.id_email, a.parte, a.nome_arquivo, a.tipo_arquivo, a.tamanho,
  md5(repeat('x', a.tamanho)) AS conteudo
FROM ({_PASS}) p JOIN captura_anexos a ON a.seq = p.seq WHERE p.resultado = 'salvo' AND a.tamanho > 0"""

SQL["raw_capture_quality"] = f"""
SELECT lote, id_email, message_id, status AS tipo_resposta, status, 'erro' AS status_validacao, FALSE AS validado,
  CASE status WHEN 'sem_anexo' THEN 'E-mail sem anexo. Não é possível realizar análise completa.'
   ELSE 'Corpo da mensagem está vazio ou fora do padrão esperado.' END AS erros, recebido_em AS data_chegada
FROM (SELECT p.*, CASE WHEN coalesce(n.n, 0) = 0 THEN 'sem_anexo' WHEN coalesce(length(corpo_email), 0) < 20 THEN 'fora_do_padrao' END AS status
  FROM ({_PASS}) p LEFT JOIN (SELECT seq, count(*) AS n FROM captura_anexos WHERE tamanho > 0 GROUP BY seq) n ON n.seq = p.seq
  WHERE resultado = 'salvo') q WHERE status IS NOT NULL"""

SQL["raw_capture_outcomes"] = f"""
SELECT lote, resultado, message_id, count(*) AS n, count(CASE WHEN falha THEN 1 END) AS n_erros FROM ({_PASS}) p
GROUP BY lote, resultado, message_id"""

SQL["raw_capture_progress"] = f"""
SELECT *, CAST(sum(total) OVER (ORDER BY lote) - 1 AS BIGINT) AS atual FROM (
 SELECT lote, TRUE AS com_arquivos, count(*) AS total, count(CASE WHEN resultado = 'salvo' THEN 1 END) AS salvos,
  count(CASE WHEN resultado = 'duplicado' THEN 1 END) AS duplicados, count(CASE WHEN resultado = 'falha' THEN 1 END) AS falhas,
  count(CASE WHEN resultado = 'ignorado' THEN 1 END) AS ignorados FROM ({_PASS}) p GROUP BY lote) t"""


# -- upserts of touched ranges: the same tables as whole rewrites -------------------------
SQL["reply_upsert_ranges"] = O.SQL["reply_upsert"]
SQL["filing_update_ranges"] = O.SQL["filing_update"]

SQL["stream_validation_log"] = O.SQL["stream_validation"]

# -- scorer ------------------------------------------------------------------------------
_CALL = "CASE WHEN id_email % 11 = 4 THEN 'tempo esgotado' WHEN id_email % 13 = 6 THEN 'sem resposta do avaliador' END"
SQL["scored_verdicts"] = f"""
SELECT id_email, erro_chamada,
  CASE WHEN erro_chamada IS NULL AND k = 0 THEN TRUE WHEN erro_chamada IS NULL AND k = 1 THEN FALSE END AS valido,
  CASE WHEN erro_chamada IS NULL AND k = 0 THEN TRUE END AS coerencia,
  CASE WHEN erro_chamada IS NOT NULL THEN 'IA não executada — erro de API: ' || erro_chamada WHEN k = 0 THEN 'ok'
   WHEN k = 1 THEN 'sem minuta' ELSE 'IA não respondeu em JSON válido. Conteúdo bruto: Desculpe, nao posso.' END AS motivo,
  CASE WHEN erro_chamada IS NOT NULL OR k = 2 THEN 'aguardar' WHEN k = 0 THEN 'protocolar' ELSE 'rejeitar' END AS acao_sugerida,
  CASE WHEN erro_chamada IS NOT NULL THEN erro_chamada WHEN k = 2 THEN 'json_decode_error' END AS erro_ia,
  CASE WHEN erro_chamada IS NULL AND k = 1 THEN 'minuta' ELSE '' END AS faltantes
FROM (SELECT e.id_email, {_CALL.replace("id_email", "e.id_email")} AS erro_chamada, e.id_email % 3 AS k FROM emails e
  WHERE e.tipo_email = 'protocolo' AND NOT EXISTS (SELECT 1 FROM protocolos p WHERE p.id_email = e.id_email)) b"""

# -- identifiers in the attachments ------------------------------------------------------
_NORM = "NULLIF(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')"
_TOKENS = r"list_concat(regexp_extract_all({0}, '(?i)(?:FNDA|DILA)[-–:/\s]{{0,3}}\d{{6,}}|\d(?:[.\-/\s]?\d)*'), regexp_extract_all({0}, '\d+'))"
SQL["identifier_evidence"] = f"""
WITH m AS (SELECT id_email, {O.case_number_sql(O.TEXT)} AS processo, {O.opaj_sql(O.TEXT)} AS opaj, {O.ident_sql(O.TEXT)} AS identificador FROM emails),
found AS (SELECT DISTINCT id_email, {_NORM.format("x")} AS token FROM (
  SELECT id_email, unnest({_TOKENS.format("nome_arquivo")}) AS x FROM anexos_email
  UNION ALL SELECT a.id_email, unnest({_TOKENS.format("c.conteudo")}) AS x FROM anexos_conteudo c JOIN anexos_email a ON a.id_anexo = c.id_anexo) t),
checks AS (SELECT m.*,
  CASE WHEN processo IS NOT NULL THEN (id_email, {_NORM.format("processo")}) IN (SELECT (id_email, token) FROM found) END AS processo_ok,
  CASE WHEN opaj IS NOT NULL THEN (id_email, {_NORM.format("opaj")}) IN (SELECT (id_email, token) FROM found) END AS opaj_ok,
  CASE WHEN identificador IS NOT NULL THEN (id_email, {_NORM.format("identificador")}) IN (SELECT (id_email, token) FROM found) END AS identificador_ok
  FROM m)
SELECT *, coalesce(processo_ok, TRUE) AND coalesce(opaj_ok, TRUE) AND coalesce(identificador_ok, TRUE) AS ids_ok FROM checks"""

# -- case detail, backlog page, report and log files -------------------------------------
SQL["case_detail_rows"] = """
SELECT id_email, 'email' AS secao, id_email AS id, assunto, remetente, recebido_em, corpo_email, NULL AS status_final,
 NULL AS processo, NULL AS opaj, NULL AS nome_arquivo, NULL AS tipo_arquivo, NULL AS acao_usuario, NULL AS usuario,
 CAST(NULL AS TIMESTAMP) AS data_registro, NULL AS nome_recibo FROM emails
UNION ALL SELECT id_email, 'resposta', id_resposta, NULL, NULL, NULL, NULL, status_final, processo, opaj, NULL, NULL, NULL, NULL, NULL, NULL
 FROM respostas WHERE id_email IN (SELECT id_email FROM emails)
UNION ALL SELECT id_email, 'anexo', id_anexo, NULL, NULL, NULL, NULL, NULL, NULL, NULL, nome_arquivo, tipo_arquivo, NULL, NULL, NULL, NULL
 FROM anexos_email WHERE id_email IN (SELECT id_email FROM emails)
UNION ALL SELECT id_email, 'protocolo', id_protocolo, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, acao_usuario, usuario_protocolo,
 coalesce(protocolado_em, criado_em), recibo_protocolo FROM protocolos WHERE id_email IN (SELECT id_email FROM emails)"""

SQL["validation_backlog_page"] = """
SELECT e.* FROM emails e WHERE e.tipo_email = 'protocolo'
 AND NOT EXISTS (SELECT 1 FROM protocolos p WHERE p.id_email = e.id_email) ORDER BY e.id_email LIMIT 25"""

SQL["validation_backlog_day"] = """
SELECT e.* FROM emails e WHERE e.tipo_email = 'protocolo' AND CAST(e.recebido_em AS DATE) = DATE '1995-07-21'
 AND NOT EXISTS (SELECT 1 FROM protocolos p WHERE p.id_email = e.id_email)"""

SQL["report_export"] = """
SELECT p.id_protocolo, p.id_email, p.status, e.assunto, e.remetente, e.recebido_em, r.processo, r.opaj,
  strftime(e.recebido_em, '%Y-%m') AS mes
FROM protocolos p JOIN emails e ON e.id_email = p.id_email LEFT JOIN respostas r ON r.id_resposta = p.id_resposta
WHERE e.tipo_email = 'protocolo' AND CAST(e.recebido_em AS DATE) >= DATE '1996-01-01' AND CAST(e.recebido_em AS DATE) <= DATE '1996-12-31'"""

SQL["outcome_log"] = f"""
SELECT CASE WHEN resultado = 'falha' THEN 'ERROR' ELSE 'INFO' END AS tipo, 'E-mail #' || seq || ': ' || resultado AS mensagem,
  '2026-01-01 00:00:00' AS timestamp FROM ({O.OUTCOMES}) o"""


def oracle_sql() -> dict[str, str]:
    return {name: O.with_fixtures(sql) for name, sql in SQL.items()}

# -- courts, names in long form, sender headers, repeated keys ---------------------------
SQL["report_by_court"] = """
SELECT p.*, e.assunto, e.remetente, e.recebido_em, e.tipo_email, r.tipo_resposta, r.processo, r.opaj
FROM protocolos p JOIN emails e ON e.id_email = p.id_email JOIN respostas r ON r.id_resposta = p.id_resposta
WHERE e.tipo_email = 'protocolo' AND CAST(e.recebido_em AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
  AND split_part(r.processo, '.', 3) || '.' || split_part(r.processo, '.', 4) = '8.26'
ORDER BY p.criado_em DESC NULLS FIRST, p.id_protocolo"""

SQL["court_totals"] = """
SELECT CASE WHEN processo IS NOT NULL THEN split_part(processo, '.', 3) || '.' || split_part(processo, '.', 4) END AS tribunal,
  count(*) AS n_respostas, count(DISTINCT processo) AS n_processos FROM respostas GROUP BY 1"""

SQL["attachment_name_rows"] = """
SELECT id_email, row_number() OVER (PARTITION BY id_email ORDER BY id_anexo, nome_arquivo) AS posicao, id_anexo, nome_arquivo
FROM anexos_email"""

SQL["sender_forms"] = """
SELECT seq, lower(remetente) AS endereco FROM captura WHERE lower(remetente) = 'respostas@example.com'"""

SQL["verdict_repeated_keys"] = f"""
SELECT id_email, valido, coerencia, motivo, acao_sugerida, erro_ia FROM ({O.PARSED}) v"""
