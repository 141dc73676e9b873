"""Written tables, scalable ordering, and the site's queries put together."""
