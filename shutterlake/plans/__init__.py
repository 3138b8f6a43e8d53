"""Physical shapes that operators share: graph components and bounded joins."""
