"""Record types of the dataflow."""

from __future__ import annotations

WEBHOOK = "userRequest struct<utterance:string,callbackUrl:string>"
