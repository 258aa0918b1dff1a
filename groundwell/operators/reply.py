"""Requests, routing and reply envelopes of the chat front end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text
from ..schemas import WEBHOOK


def request(body: Column) -> Column:  # S11
    r = F.from_json(body, WEBHOOK)["userRequest"]
    return F.struct(F.coalesce(r["utterance"], F.lit("")).alias("utterance"), r["callbackUrl"].alias("callback_url"))


def route(utterance: Column, words: list[str] | None = None) -> Column:  # P17
    return F.when(text.any_word(utterance, C.COMIC_WORDS if words is None else words), "image").otherwise("text")


def wait_message(utterance: Column) -> Column:  # P27
    return F.when(text.any_word(utterance, C.COMIC_WORDS), C.WAIT_COMIC).otherwise(C.WAIT_TEXT)


def reply_text(utterance: Column, answer: Column, fallback: Column | None = None) -> Column:  # P18, P26, L6
    best = F.coalesce(F.nullif(answer, F.lit("")), fallback) if fallback is not None else answer
    return F.when(utterance == "", F.lit(C.EMPTY_UTTERANCE)).otherwise(F.left(best, F.lit(C.DEFAULT.reply_chars)))


def _outputs(*items: Column) -> Column:
    return F.array(*[F.to_json(i) for i in items])


def envelope(outputs: Column) -> Column:  # P21
    """outputs: array of JSON texts."""
    return F.concat(F.lit('{"version":"2.0","template":{"outputs":['), F.array_join(outputs, ","), F.lit("]}}"))


def with_key(payload: Column, key: Column) -> Column:  # S12
    """A payload (a JSON object) with a key by which its receiver tells repeats."""
    return F.regexp_replace(payload, F.lit(r"^\s*\{"), F.concat(F.lit('{"idempotencyKey":"'), key, F.lit('",')))


def simple_text(x: Column) -> Column:
    return F.struct(F.struct(x.alias("text")).alias("simpleText"))


def simple_image(url: Column) -> Column:
    return F.struct(F.struct(url.alias("imageUrl"), F.lit(C.IMAGE_ALT).alias("altText")).alias("simpleImage"))


def basic_card(url: Column) -> Column:
    return F.struct(
        F.struct(F.lit(C.CARD[0]).alias("title"), F.lit(C.CARD[1]).alias("description"), F.struct(url.alias("imageUrl")).alias("thumbnail")).alias("basicCard")
    )


def reply(utterance: Column, answer: Column, image: Column) -> Column:
    """The callback's payload: an image or the notice that it failed, else the text."""
    pictured = F.when(image.isNotNull(), envelope(_outputs(simple_image(image)))).otherwise(envelope(_outputs(simple_text(F.lit(C.IMAGE_FAILED)))))
    return F.when(route(utterance) == "image", pictured).otherwise(envelope(_outputs(simple_text(reply_text(utterance, answer)))))


def card_reply(answer: Column, image: Column) -> Column:  # L8
    """Text with an optional card before it, in one bubble list."""
    return F.when(image.isNotNull(), envelope(_outputs(basic_card(image), simple_text(answer)))).otherwise(envelope(_outputs(simple_text(answer))))


def text_acknowledgement(callback: Column, answer: Column) -> Column:  # P21
    """The acknowledgement whose text is under ``data``; without a callback the answer itself."""
    ack = F.to_json(F.struct(F.lit("2.0").alias("version"), F.lit(True).alias("useCallback"), F.struct(F.lit(C.WAIT_ANSWER).alias("text")).alias("data")))
    return F.when(F.coalesce(callback, F.lit("")) != "", ack).otherwise(envelope(_outputs(simple_text(answer))))


def illustrated(utterance: Column, answer: Column, image: Column) -> Column:  # L8, P17
    """The text with a card before it, where the utterance asks for a picture and there is one."""
    return card_reply(answer, F.when(route(utterance, C.IMAGE_WORDS) == "image", image))


def acknowledgement(utterance: Column, callback: Column) -> Column:
    ack = F.concat(
        F.lit('{"version":"2.0","useCallback":true,"template":{"outputs":['), F.to_json(simple_text(wait_message(utterance))), F.lit("]}}")
    )
    return F.when(callback.isNotNull() & (callback != ""), ack).otherwise(envelope(_outputs(simple_text(F.lit(C.STATUS_OK)))))
