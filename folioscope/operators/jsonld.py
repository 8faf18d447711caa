"""JSON-LD builders: schema.org objects as JSON columns; optional keys that are null are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTEXT = "https://schema.org"


def _object(kind: str, *, context: bool = True, **fields: Column | None) -> Column:
    head = [F.lit(_CONTEXT).alias("@context")] if context else []
    return F.struct(*head, F.lit(kind).alias("@type"), *[v.alias(k.replace("at_", "@")) for k, v in fields.items() if v is not None])


def faq(pairs: Column) -> Column:
    """Of an array of ``question::answer``; null if one lacks the separator."""

    def question(pair: Column) -> Column:
        parts = F.split(pair, "::", 2)
        answer = _object("Answer", context=False, text=F.trim(parts[1]))
        return _object("Question", context=False, name=F.trim(parts[0]), acceptedAnswer=answer)

    made = F.to_json(_object("FAQPage", mainEntity=F.transform(pairs, question)))
    return F.when(F.forall(pairs, lambda p: F.contains(p, F.lit("::"))), made)


def article(title: Column, description: Column, published: Column, author: Column, modified: Column | None = None, credentials: Column | None = None, author_url: Column | None = None, org_name: Column | None = None, org_url: Column | None = None, url: Column | None = None, image: Column | None = None) -> Column:
    """An Article; the date of modification defaults to that of publication."""
    writer = _object("Person", context=False, name=author, honorificSuffix=credentials, url=author_url)
    publisher = page = None
    if org_name is not None:
        publisher = F.when(org_name.isNotNull(), _object("Organization", context=False, name=org_name, url=org_url))
    if url is not None:
        page = F.when(url.isNotNull(), _object("WebPage", context=False, at_id=url))
    dated = published if modified is None else F.coalesce(modified, published)
    return F.to_json(_object("Article", headline=title, description=description, datePublished=published, dateModified=dated, author=writer, publisher=publisher, mainEntityOfPage=page, image=image))


def howto(name: Column, steps: Column, description: Column | None = None) -> Column:
    numbered = F.transform(steps, lambda s, i: _object("HowToStep", context=False, position=i + 1, text=s))
    return F.to_json(_object("HowTo", name=name, step=numbered, description=description))


def organization(name: Column, url: Column | None = None, logo: Column | None = None, same_as: Column | None = None) -> Column:
    links = None if same_as is None else F.when(F.size(same_as) > 0, same_as)
    return F.to_json(_object("Organization", name=name, url=url, logo=logo, sameAs=links))


def person(name: Column, job_title: Column | None = None, credentials: Column | None = None, url: Column | None = None, works_for: Column | None = None) -> Column:
    employer = None if works_for is None else F.when(works_for.isNotNull(), _object("Organization", context=False, name=works_for))
    return F.to_json(_object("Person", name=name, jobTitle=job_title, honorificSuffix=credentials, url=url, worksFor=employer))
