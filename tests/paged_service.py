"""A small paged service: five pages of one video's threads, three of another's, an empty one's, and none of one that is gone."""

from spanloom.sources.rest import HttpError

PAGES = {"a": 5, "b": 3, "c": 0}


def fetch(kind, params):
    key, at = params["videoId"], int(params["pageToken"] or 0)
    if key == "gone":
        raise HttpError(404)
    token = {"nextPageToken": str(at + 1)} if at + 1 < PAGES[key] else {}
    if params.get("fields") == "nextPageToken":
        return token
    return token | {"items": [{"id": f"{key}{at}-{k}"} for k in range(2)] if PAGES[key] else []}
