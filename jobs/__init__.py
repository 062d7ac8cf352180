"""Jobs that users of the library run as they are: a chunk feed and a review of answers."""
