"""Table schemas of the mail-workflow data model and the status vocabularies.

Column names stay in the data model's own language (Portuguese) so a user of
the original tables can switch without renaming anything.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, B, TS = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
ARR_S = T.ArrayType(T.StringType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


EMAILS = _schema(("id_email", L), ("message_id", S), ("remetente", S), ("assunto", S),
                 ("recebido_em", TS), ("corpo_email", S), ("tipo_email", S))

ANEXOS_EMAIL = _schema(("id_anexo", L), ("id_email", L), ("nome_arquivo", S),
                       ("tipo_arquivo", S))

# Attachment bytes live in their own table keyed by id_anexo, so no listing,
# join or shuffle ever carries them.
ANEXOS_CONTEUDO = _schema(("id_anexo", L), ("conteudo", T.BinaryType()))

PROTOCOLOS = _schema(("id_protocolo", L), ("id_email", L), ("id_resposta", L), ("status", S),
                     ("acao_usuario", S), ("usuario_protocolo", S), ("recibo_protocolo", S),
                     ("motivo_invalido", S), ("observacao", S), ("hash_documento", S),
                     ("hash_email", S), ("criado_em", TS), ("ultima_atualizacao", TS),
                     ("protocolado_em", TS))

RESPOSTAS = _schema(("id_resposta", L), ("id_email", L), ("id_anexo", L), ("tipo_resposta", S),
                    ("processo", S), ("opaj", S), ("identificador", S), ("status", S),
                    ("status_validacao", S), ("status_final", S), ("acao_sugerida", S),
                    ("motivo_invalido", S), ("resumo_ia", S), ("observacao", S),
                    ("coerente", B), ("validado", B), ("erros", ARR_S), ("nomes_anexos", ARR_S),
                    ("data_chegada", TS))

DIVERGENCIAS = _schema(("id_divergencia", L), ("id_protocolo", L), ("usuario", S),
                       ("motivo_manual", S), ("observacao", S), ("data_registro", TS))

VALIDACOES = _schema(("id_validacao", L), ("id_resposta", L), ("data_validacao", TS),
                     ("resultado", S))

CONTROLE_PIPELINE = _schema(("chave", S), ("valor", S))

USUARIOS = _schema(("username", S), ("nome", S), ("perfil", S), ("ativo", B))

# Raw mail as landed bytes (binaryFile layout).
RAW_MAIL = _schema(("path", S), ("modificationTime", T.TimestampType()), ("length", L),
                   ("content", T.BinaryType()))

ATTACHMENT_PART = T.StructType([
    T.StructField("nome_arquivo", S), T.StructField("tipo_arquivo", S),
    T.StructField("conteudo", T.BinaryType()),
])

PARSED_MAIL = _schema(("path", S), ("message_id", S), ("remetente", S), ("assunto", S),
                      ("recebido_em_raw", S), ("corpo_email", S),
                      ("anexos", T.ArrayType(ATTACHMENT_PART)), ("erro_parse", S), ("conteudo_sha256", S))
