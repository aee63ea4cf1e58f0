"""The engine joins one finished dataset with itself, so it is batch only.

Nothing lives here: a pair may be completed by any later item, so no watermark can ever retire state. A stream is
handled by running the batch join on what has landed.
"""
